"""Problem 5: near-duplicate records by minima of many universal hashes.

Plan: one Arrow pass turns each text into (hash of its shingle set, number of shingles, signature); the signature is
written once. Records with one and the same shingle set are a class, and only its lowest id goes on, so copies
never meet in a bucket. Each of the signature's bands is a 64-bit key of `ROWS` 16-bit minima; equal keys join.
Candidates are verified by agreement of signatures and then exactly, on their texts; each of the two steps
brings the data to the pairs in long form, so a table is shuffled once and not once a side.

Groups don't need every pair. Each member of a bucket is first compared with the bucket's lowest alone, and what is similar is
connected; only members of one bucket that are still in different groups are then compared with each other. So a family of texts that differ
by small edits costs a row a member and bucket, not a row a pair, and no link between two groups is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, cut, keyed, table, texts_of
from .components import connected_components
from .wordhash import blocks, decompose, mix, shingle_hashes, word_hashes

#: A band is one 64-bit key of four 16-bit minima. Two texts of similarity s share a band with probability
#: 1 - (1 - s^4)^40: 0.996 at 0.6, 0.9995 at 0.65, 1 - 3e-7 at 0.75.
ROWS, BANDS = 4, 40
#: Bands whose minima are compared when a candidate's signature is verified.
VERIFIED = 16
#: Standard deviations by which a signature's agreement may fall short of the threshold before a candidate goes.
SLACK = 4.6
_SEED = 20
#: Records whose keys are looked at for hot buckets, and how many of them a hot one holds at least; its rows are dealt to SALTS tasks.
SAMPLED, HOT, SALTS = 20_000, 200, 64


def _family() -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of the multiply-shift hashes x -> (a x + b) >> 32 of 32-bit x."""
    r = np.random.default_rng(_SEED)
    a = r.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], r.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """BANDS keys of 64 bits; lane j of key i is the low 16 bits of minimum 4 i + j."""
    a, b = family
    x, best = shingles >> np.uint64(32), None
    for k in range(0, len(x), 2048):
        m = ((a * x[None, k : k + 2048] + b) >> np.uint64(32)).min(axis=1)
        best = m if best is None else np.minimum(best, m)
    keys = best.astype(np.uint16).view(np.uint64)
    return keys ^ mix(np.arange(1, BANDS + 1, dtype=np.uint64))  # so that a key tells its band


def _signatures(words: int):
    def make():
        family = _family()

        def f(batch: pa.RecordBatch) -> dict:
            texts, ids = texts_of(batch, "c0"), batch.column("id").to_pylist()
            out: dict[str, list] = {k: [] for k in ("id", "set_a", "set_b", "n", "sig")}
            for lo, hi in blocks(texts):
                s, at = shingle_hashes(*word_hashes([decompose(t) for t in texts[lo:hi]]), words)
                for k in range(hi - lo):
                    if at[k] == at[k + 1]:
                        continue
                    own = np.unique(s[at[k] : at[k + 1]])
                    out["id"].append(ids[lo + k])
                    out["set_a"].append(int(own.sum(dtype=np.uint64).view(np.int64)))
                    out["set_b"].append(int(mix(own).sum(dtype=np.uint64).view(np.int64)))
                    out["n"].append(len(own))
                    out["sig"].append(signature(own, family).view(np.int64))
            sig = pa.ListArray.from_arrays(np.arange(len(out["sig"]) + 1, dtype=np.int32) * BANDS, np.concatenate(out["sig"]) if out["sig"] else np.zeros(0, np.int64))
            return out | {"sig": sig}

        return f

    return make


def _agreement(threshold: float):
    least = threshold - SLACK * (threshold * (1 - threshold) / (ROWS * VERIFIED)) ** 0.5

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            a, b = (np.asarray(batch.column(c).flatten()).view(np.uint16).reshape(-1, ROWS * VERIFIED) for c in ("va", "vb"))
            return {c: batch.column(c).filter(pa.array((a == b).mean(axis=1) >= least)) for c in ("a", "b")}

        return f

    return make


def _exact(words: int, threshold: float):
    def make():
        def sets(texts: list[str]) -> list[np.ndarray]:
            out = []
            for lo, hi in blocks(texts):
                s, at = shingle_hashes(*word_hashes([decompose(t) for t in texts[lo:hi]]), words)
                out += [np.unique(s[at[k] : at[k + 1]]) for k in range(hi - lo)]
            return out

        def f(batch: pa.RecordBatch) -> dict:
            sims = []
            for x, y in zip(sets(texts_of(batch, "va")), sets(texts_of(batch, "vb"))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(both / max(1, len(x) + len(y) - both))
            keep = pa.array([s >= threshold for s in sims], type=pa.bool_())
            return {"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep), "similarity": pa.array(sims, type=pa.float64()).filter(keep)}

        return f

    return make


def _beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """a, b, va, vb: the values (id, v) of both sides of each pair."""
    long = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id")).join(values, "id")
    both = long.groupBy("a", "b").agg(F.min(F.struct("id", "v")).alias("x"), F.max(F.struct("id", "v")).alias("y"))
    return both.select("a", "b", F.col("x.v").alias("va"), F.col("y.v").alias("vb"))


def _base(df: DataFrame, id_col: str, text_col: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(id and text of each row with an id; signatures of those with enough words)."""
    docs = keyed(df, id_col, text_col)
    return docs, cut(arrow_map(docs.where("c0 is not null"), _signatures(words), "id long, set_a long, set_b long, n int, sig array<bigint>"))


def _keys(base: DataFrame) -> DataFrame:
    """id, key of each band of each class's lowest record."""
    classes = base.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("id", "sig")).alias("m")).select("m.id", "m.sig")
    return classes.select("id", F.explode("sig").alias("key"))


def _members(base: DataFrame) -> DataFrame:
    sets = base.select("id", "set_a", "set_b", "n")
    lowest = sets.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("class_id"))
    return sets.join(lowest, ["set_a", "set_b", "n"]).select("id", "class_id").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, base: DataFrame, words: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar, with their similarity."""
    likely = arrow_map(_beside(pairs, base.select("id", F.slice("sig", 1, VERIFIED).alias("v"))), _agreement(threshold), "a long, b long")
    return cut(arrow_map(_beside(likely, docs.select("id", F.col("c0").alias("v"))), _exact(words, threshold), "a long, b long, similarity double"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts whose sets of `words`-word sequences have a Jaccard similarity >= threshold.

    members: id, class_id. Texts with the same set of sequences are one class, named by its lowest id.
    links: a, b (class ids, a < b), similarity. Every link between different classes is in it, however many a class has.

    Words are runs of letters or digits, without case or accents. Null, empty and short texts (fewer than `words`
    words) and rows without an id are in neither table. Rows repeated under one id count once. Empty tables give
    empty results. A text is read whole whatever its length.
    """
    docs, base = _base(df, id_col, text_col, words)
    keys = _keys(base)
    pairs = keys.select(F.col("id").alias("a"), "key").join(keys.select(F.col("id").alias("b"), "key"), "key").where("a < b").select("a", "b").distinct()
    return _members(base), _verified(pairs, docs, base, words, threshold)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, salt, id, hot) in order: each with the lowest id of its key and salt. Lone ones are left out, but for hot keys the lowest
    comes too, as a tie to those of other salts."""
    last = low = None
    for batch in batches:
        key, salt, ids, hot = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "salt", "id", "hot"))
        if not len(key):
            continue
        new = np.concatenate(([last != (key[0], salt[0])], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lows = np.where(at >= 0, ids[at], low)
        last, low = (key[-1], salt[-1]), lows[-1]
        keep = ~new | hot
        yield pa.RecordBatch.from_pydict({"key": key[keep], "low": lows[keep].astype(np.int64), "id": ids[keep], "tie": (new & hot)[keep]})


def _buckets(keys: DataFrame, n_records: int) -> DataFrame:
    """key, low, id of each record in a bucket of two or more but one, the lowest, whom the others have as low. Rows of a hot key are dealt to several
    tasks, and the lowest of each joined to the lowest of all; whether a key counts as hot changes only where its rows go."""
    some = keys.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n_records // SAMPLED))) == 0)
    hot = [r[0] for r in some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT).select("key").collect()]  # at most BANDS * SAMPLED / HOT, about
    known = keys.sparkSession.createDataFrame([(k, True) for k in hot], "key long, hot boolean")
    rows = keys.join(F.broadcast(known), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    dealt = rows.select("key", "salt", "id", "hot").repartition("key", "salt").sortWithinPartitions("key", "salt", "id")
    found = cut(dealt.mapInArrow(_stars, "key long, low long, id long, tie boolean"))
    ties = found.where("tie").select("key", "id")
    lowest = ties.groupBy("key").agg(F.min("id").alias("low"))
    return found.where("not tie").select("key", "low", "id").unionByName(ties.join(lowest, "key").where("id != low").select("key", "low", "id"))


def near_groups(df: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """id, class_id, group_id of each record of enough words: its class as in near_duplicates, and the lowest class it is linked to in any number of steps.

    Texts, ids and empty tables are taken as in near_duplicates.
    """
    docs, base = _base(df, id_col, text_col, words)
    buckets = cut(_buckets(_keys(base), base.count()))
    stars = cut(buckets.select(F.least("low", "id").alias("a"), F.greatest("low", "id").alias("b")).distinct())
    first = _verified(stars, docs, base, words, threshold).select("a", "b")
    groups = connected_components(first)
    inside = buckets.select("key", "id").unionByName(buckets.select("key", F.col("low").alias("id"))).distinct()
    placed = inside.join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"))
    # buckets whose members are in one group by now, as those of a family of edited copies are, go no further
    mixed = placed.groupBy("key").agg(F.min("g").alias("g1"), F.max("g").alias("g2")).where("g1 != g2").select("key")
    placed = cut(placed.join(mixed, "key"))
    a, b = (placed.select("key", F.col("id").alias(x), F.col("g").alias(f"g_{x}")) for x in "ab")
    apart = a.join(b, "key").where("a < b and g_a != g_b").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    second = _verified(apart, docs, base, words, threshold).select("a", "b")
    groups = connected_components(first.unionByName(second))
    out = _members(base).join(groups.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    return out.select("id", "class_id", F.coalesce("component", "class_id").alias("group_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id_a < rec_id_b of every two records of similarity >= 0.6 on three-word sequences, copies included."""
    members, links = near_duplicates(table(spark, sf_dir, "culturax_it_ppl95"), "rec_id", "text", 3, 0.6)
    members = cut(members)
    a, b = (members.select(F.col("class_id").alias(c), F.col("id").alias(f"id_{c}")) for c in "ab")
    across = links.join(a, "a").join(b, "b").select("id_a", "id_b")
    shared = members.join(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "class_id")
    one, two = (shared.select("class_id", F.col("id").alias(f"id_{c}")) for c in "ab")
    within = one.join(two, "class_id").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within).select(F.least("id_a", "id_b").alias("rec_id_a"), F.greatest("id_a", "id_b").alias("rec_id_b"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record with a text of three words or more: its class of equal sequences, and the group of records it is
    linked to over any number of steps."""
    return near_groups(table(spark, sf_dir, "culturax_it_ppl95"), "rec_id", "text", 3, 0.6).withColumnRenamed("id", "rec_id")

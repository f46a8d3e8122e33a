"""Problem 2: the same or nearly the same prompts across splits, by suffix arrays over partitioned concatenated texts.

Each distinct prompt becomes a canonical text (see requests.py): its values, then its words. Words that slips of the keyboard set
apart are linked, chains of links make a group, and a text is written as the tokens of its values and groups, so a slip ends no
common prefix. The texts are partitioned: a part holds all texts of the same values, and one of more than `PART` texts
is split by longer keys that the same requests share, at last into blocks that meet two by two. The texts of each part are concatenated and
their suffixes sorted. The longest common prefixes of each suffix with its nearest neighbours of another split are the spans
that its text shares with that split; merged, they give the text's coverage. Only texts wholly covered can be the same request as
another one: each is compared with the texts that have a suffix in the narrowest of its intervals, word by word.
No step depends on how many texts share a phrase, on the order of phrases or on how many words have slips.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, cut, table
from .components import connected_components
from .requests import canonical, same_but_for_slip, same_request, squeeze
from .wordhash import mix

#: Texts of a part; more of one key are split by a longer key, or into blocks.
PART = 256
#: Tokens whose suffixes are sorted at once: whole parts, or a single text that has more.
AT_ONCE = 60_000
#: Tokens of a common span that counts in a pair's coverage.
LONG = 3
#: Words with slips up to which their groups are sent to every task (16 bytes a word); more are joined by a shuffle, with the same result.
MOST_SENT = 2_000_000
TRAIN, HELD_OUT = ("train",), ("val", "test")


def _canonical(batch: pa.RecordBatch) -> dict:
    keep, texts = [], []
    for i, prompt in enumerate(batch.column("prompt").to_pylist()):
        values, words = canonical(prompt)
        if values or words:
            keep.append(i)
            texts.append(" ".join([*values, *words]))
    at = pa.array(keep, type=pa.int64())
    return {"cls": batch.column("cls").take(at), "sides": batch.column("sides").take(at), "text": texts}


@lru_cache(100_000)
def _letter(c: str) -> int:
    return int.from_bytes(blake2b(c.encode("utf-8", "surrogatepass"), digest_size=7).digest())


def _marks(batch: pa.RecordBatch) -> dict:
    """Of each word that may have slips, the sums of its letters' hashes, each letter once: whole, and without one or two letters.

    Slips leave at most two letters out and put none in, so of two words that they set apart the whole of one is among the other's.
    """
    out: dict[str, list] = {k: [] for k in ("mark", "word", "whole", "size")}
    for word in batch.column("word").to_pylist():
        if len(word) < 3 or word[0] == "@" or any(c.isdigit() for c in word):
            continue
        letters = [_letter(c) for c in set(word)]
        whole = sum(letters)
        less = {whole - x for x in letters} | {whole - x - y for i, x in enumerate(letters) for y in letters[:i]}
        for mark in {whole} | less:
            for name, v in zip(out, (mark % 2**62, word, mark == whole, len(squeeze(word)))):
                out[name].append(v)
    return out


def _slipped(batch: pa.RecordBatch) -> dict:
    keep = pa.array([same_but_for_slip(x, y) or same_but_for_slip(y, x) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())], type=pa.bool_())
    return {c: batch.column(c).filter(keep) for c in ("a", "b")}


def slip_groups(words: DataFrame) -> DataFrame:
    """id, component: the hash of each word that slips set apart from another one of the table, and that of its group, closed over chains.

    A word without a row is a group of its own. Two words of one hash are in one group, which only brings more pairs to compare.
    """
    marks = cut(arrow_map(words.distinct(), lambda: _marks, "mark long, word string, whole boolean, size int"))
    whole = marks.where("whole").select("mark", F.col("word").alias("a"), F.col("size").alias("size_a"))
    near = whole.join(marks.select("mark", F.col("word").alias("b"), F.col("size").alias("size_b")), "mark").where("a != b and abs(size_a - size_b) <= 2")
    slipped = arrow_map(near.select("a", "b"), lambda: _slipped, "a string, b string")
    return connected_components(slipped.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))


@lru_cache(200_000)
def _hash(word: str) -> int:
    """The hash that Spark's xxhash64 gives."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


def _tokens_sent(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The texts with their tokens, by the table of groups in every task."""
    rows = groups.select("id", "component").toPandas().sort_values("id")
    sent = texts.sparkSession.sparkContext.broadcast((rows["id"].to_numpy(np.int64), rows["component"].to_numpy(np.int64)))

    def make():
        known, of = sent.value

        def f(batch: pa.RecordBatch) -> dict:
            words = [t.split(" ") for t in batch.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, words)])
            h = np.array([_hash(w) for own in words for w in own], dtype=np.uint64).view(np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                h = np.where(known[at] == h, of[at], h)
            return {c: batch.column(c) for c in ("cls", "sides", "text")} | {"tokens": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(h))}

        return f

    return arrow_map(texts, make, "cls long, sides int, text string, tokens array<bigint>")


def _tokens_joined(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """The same by a shuffle of the words' hashes."""
    words = texts.select("cls", F.posexplode(F.split("text", " ")).alias("pos", "word")).select("cls", "pos", F.xxhash64("word").alias("id"))
    of = words.join(groups, "id", "left").select("cls", F.struct("pos", F.coalesce("component", "id").alias("t")).alias("p"))
    lists = of.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.t).alias("tokens"))
    return texts.join(lists, "cls").select("cls", "sides", "text", "tokens")


_VALUES = re.compile(r"(?:@\S+(?: |\Z))*")


def _keys(batch: pa.RecordBatch) -> dict:
    """Keys of growing length that the same requests share: of the values; also of the number of words and the lowest token; of all tokens in order.
    Tokens become those of 32 bits, told apart from others of the same part in the end by the words themselves."""
    texts, lists = batch.column("text").to_pylist(), batch.column("tokens")
    tokens, ends = np.asarray(lists.flatten()).view(np.uint64), np.cumsum([0, *lists.value_lengths().to_pylist()])
    size = np.diff(ends)
    values = np.array([_hash(_VALUES.match(t)[0].rstrip()) for t in texts], dtype=np.uint64)
    own = tokens[np.lexsort((tokens, np.repeat(np.arange(len(size)), size)))]  # each text's in order
    at = np.arange(len(own)) - np.repeat(ends[:-1], size)
    whole = mix(np.add.reduceat(mix(own * (2 * at + 1).astype(np.uint64)), ends[:-1]) ^ values)
    short = mix(mix(values ^ size.astype(np.uint64)) ^ own[ends[:-1]])
    keys = {f"key_{k}": pa.array(v.view(np.int64)) for k, v in ((1, values), (2, short), (3, whole))}
    few = pa.array(tokens.astype(np.uint32).view(np.int32))
    return {c: batch.column(c) for c in ("cls", "sides", "text")} | keys | {"tokens": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), few)}


def _parts(texts: DataFrame, most: int) -> DataFrame:
    """cls, sides, text, tokens, part, block, other: the texts with their part. block is a text's own block and other the one it meets there;
    both are 0 but in a part that no key splits, whose texts are in as many parts as there are blocks."""
    keyed = cut(arrow_map(texts, lambda: _keys, "cls long, sides int, text string, key_1 long, key_2 long, key_3 long, tokens array<int>"))
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"key_{k}").alias("key")) for k in (1, 2, 3))))
    # keys of more than `most` texts: at most a row for so many texts
    large = cut(keyed.select(levels.alias("l")).groupBy("l.level", "l.key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    out = keyed
    for k in (1, 2, 3):
        out = out.join(large.where(F.col("level") == k).select(F.col("key").alias(f"key_{k}"), F.col("n").alias(f"n_{k}")), f"key_{k}", "left")
    blocks = F.when(F.col("n_3").isNotNull() & F.col("n_2").isNotNull() & F.col("n_1").isNotNull(), F.ceil(F.col("n_3") * 2 / most)).otherwise(1).cast("int")
    out = out.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("n_1").isNull(), F.struct(F.lit(1).alias("k"), F.col("key_1").alias("v"))).when(F.col("n_2").isNull(), F.struct(F.lit(2).alias("k"), F.col("key_2").alias("v"))).otherwise(F.struct(F.lit(3).alias("k"), F.col("key_3").alias("v")))
    part = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    return out.select("cls", "sides", "text", "tokens", part.alias("part"), "block", "other")


class SuffixArray:
    """The sorted suffixes of concatenated texts of tokens; a suffix ends with its text.

    Ranks by the first 1, 2, 4, ... tokens are kept; they give the longest common prefix of any two suffixes.
    """

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray):
        self.offsets, n = offsets, len(tokens)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)  # tokens from here to the text's end
        rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
        self.ranks, size, distinct = [rank], 1, int(rank.max(initial=0))
        while True:
            after = np.where(self.left > size, np.concatenate((rank[size:], np.zeros(min(size, n), np.int64)))[:n], 0)
            rank = np.unique(rank * (distinct + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
            if int(rank.max(initial=0)) == distinct:
                break
            size, distinct = 2 * size, int(rank.max(initial=0))
            self.ranks.append(rank)
        self.order = np.argsort(rank, kind="stable")

    def common_prefix(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the suffixes at i and j, pair by pair."""
        equal = self.ranks[-1][i] == self.ranks[-1][j]  # wholly, for the last ranks tell any two suffixes apart
        got = np.where(equal, self.left[i], 0)
        last = len(self.left) - 1
        for k in range(len(self.ranks) - 2, -1, -1):
            room = np.minimum(self.left[i], self.left[j]) - got >= 1 << k
            a, b = np.minimum(i + got, last), np.minimum(j + got, last)
            got += np.where(room & (self.ranks[k][a] == self.ranks[k][b]), 1 << k, 0)
        return got


def _nearest(known: np.ndarray) -> np.ndarray:
    """For each place of the order the last one before it where `known` holds; -1 without one."""
    at = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    return np.concatenate(([-1], at[:-1])) if len(at) else at


def spans(array: SuffixArray, sides: np.ndarray) -> np.ndarray:
    """For each position the longest prefix that its suffix shares with one of another text of another split.

    sides: bits of the splits that each text has. Of all suffixes of a split the nearest ones in the order, on either side, have the longest prefix in common.
    """
    out = np.zeros(len(array.text), dtype=np.int64)
    for order in (array.order, array.order[::-1]):
        text = array.text[order]
        own = sides[text]
        new = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
        before = np.maximum.accumulate(np.where(new, np.arange(len(text)), 0)) - 1  # the last place of another text
        near = np.where(own == 3, before, np.where(own == 1, _nearest((own & 2) > 0), _nearest((own & 1) > 0)))
        has = np.flatnonzero(near >= 0)
        i, j = order[has], order[near[has]]
        out[i] = np.maximum(out[i], array.common_prefix(i, j))
    return out


def coverage(array: SuffixArray, lengths: np.ndarray, least: int = 1) -> np.ndarray:
    """For each text the share of its tokens that lie in spans (of these lengths from each position) of `least` tokens or more."""
    at = np.arange(len(lengths))
    reach = np.where(lengths >= least, at + lengths, 0)
    # spans end with their text, so none reaches into the next one
    covered = np.maximum.accumulate(reach) > at if len(at) else np.zeros(0, bool)
    sums = np.concatenate(([0], np.cumsum(covered)))
    return (sums[array.offsets[1:]] - sums[array.offsets[:-1]]) / np.maximum(np.diff(array.offsets), 1)


def candidates(array: SuffixArray, sides: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts (held out, training) of equally many tokens, both wholly covered, that may be the same request.

    A text meets those that have a suffix in the narrowest of its intervals: the suffixes that begin with one of its tokens, in the order
    all together. Whoever has the same tokens has one there.
    """
    first, size = array.ranks[0], np.diff(array.offsets)
    use = whole[array.text] & ((sides[array.text] & 1) > 0)
    mine = array.order[use[array.order]]  # training suffixes in their order, so those of one token lie together
    n_ranks = int(first.max(initial=0)) + 1
    width = np.bincount(first[mine], minlength=n_ranks)
    begin = np.concatenate(([0], np.cumsum(width)))
    held = np.flatnonzero(whole & ((sides & 2) > 0) & (size > 0))
    if not len(held) or not len(mine):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    widths = width[first].astype(np.int64)
    low = np.minimum.reduceat(widths, array.offsets[:-1][size > 0])
    lowest = np.zeros(len(size), dtype=np.int64)
    lowest[size > 0] = low
    at = np.flatnonzero(widths == lowest[array.text])
    place = np.full(len(size), -1)
    place[array.text[at][::-1]] = at[::-1]  # the first of the narrowest
    rank = first[place[held]]
    n = width[rank]
    x = np.repeat(held, n)
    y = array.text[mine[np.repeat(begin[rank], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
    keep = (x != y) & (size[x] == size[y])
    pairs = np.unique(np.stack((x[keep], y[keep])), axis=1)
    return pairs[0], pairs[1]


def _cover(x: np.ndarray, y: np.ndarray) -> float:
    """Share of x's tokens in spans of LONG tokens or more (all of them, in shorter texts) that y has too."""
    n = min(LONG, len(x), len(y))
    there = {tuple(y[i : i + n]) for i in range(len(y) - n + 1)}
    covered = np.zeros(len(x), dtype=bool)
    for i in range(len(x) - n + 1):
        if tuple(x[i : i + n]) in there:
            covered[i : i + n] = True
    return float(covered.mean())


def _form(text: str) -> tuple[list[str], list[str]]:
    words = text.split(" ")
    return [w for w in words if w[0] == "@"], [w for w in words if w[0] != "@"]


def _same_in(rows: list[tuple]) -> Iterator[tuple]:
    """(a, b, cover_a, cover_b) of the same requests among whole parts of rows (part, cls, sides, block, other, text, tokens)."""
    tokens = np.concatenate([r[6].view(np.uint32).astype(np.uint64) for r in rows])
    offsets = np.concatenate(([0], np.cumsum([len(r[6]) for r in rows])))
    part = np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64)
    # tokens of different parts are different ones
    array = SuffixArray(mix(tokens ^ mix(np.repeat(part, np.diff(offsets)))), offsets)
    sides = np.array([r[2] for r in rows], dtype=np.int64)
    whole = coverage(array, spans(array, sides)) == 1
    forms: dict[int, tuple] = {}
    for x, y in zip(*map(np.ndarray.tolist, candidates(array, sides, whole))):
        if x > y and sides[x] == sides[y] == 3:
            continue  # met the other way round too
        a, b = rows[x], rows[y]
        if a[3] == b[3] and a[3] != a[4]:
            continue  # two texts of one block meet in the part of that block alone
        for k in (x, y):
            if k not in forms:
                forms[k] = _form(rows[k][5])
        if same_request(forms[x], forms[y]):
            if a[1] > b[1]:
                a, b = b, a
            yield a[1], b[1], _cover(a[6], b[6]), _cover(b[6], a[6])


def _links():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("part", "cls", "sides", "block", "other", "text", "tokens")
        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cover_a", pa.float64()), ("cover_b", pa.float64())])
        rows: list[tuple] = []
        size = begin = 0  # tokens, and where the last part begins

        def done(some: list[tuple]) -> pa.RecordBatch:
            found = list(_same_in(some))
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=t.type) for k, t in enumerate(kinds)], schema=kinds)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in names[:-1]]
            for *row, tokens in zip(*cols, batch.column("tokens")):
                if rows and row[0] != rows[-1][0]:
                    begin = len(rows)
                    if size >= AT_ONCE:
                        yield done(rows)
                        rows, size, begin = [], 0, 0
                rows.append((*row, np.array(tokens.values, dtype=np.int32)))
                size += len(rows[-1][6])
        if rows:
            yield done(rows)

    return run


def cross_split(df: DataFrame, id_col: str, prompt_col: str, split_col: str, source_col: str, part: int = PART, most_sent: int = MOST_SENT) -> tuple[DataFrame, DataFrame]:
    """(members: id, split, source, side, cls, sides; links: a, b, cover_a, cover_b) of prompts that occur on both sides.

    Members of one class have the same prompt, letter by letter; a link joins two classes a < b of the same request, one with a training row
    and the other with a held-out one. cover_a is the share of a's tokens in spans of `LONG` or more that b has too. Rows without
    an id or a split, with another split, or with a null, empty or wordless prompt are in no link, nor in a class of both sides.
    Rows repeated under one id are members once for each split and source. Sources may be null. Empty tables give empty results.
    """
    side = F.when(F.col("split").isin(*TRAIN), 1).when(F.col("split").isin(*HELD_OUT), 2)
    rows = df.select(df[id_col].alias("id"), df[prompt_col].alias("prompt"), df[split_col].alias("split"), df[source_col].alias("source"))
    rows = rows.where("id is not null and prompt is not null").where(side.isNotNull()).withColumn("side", side).withColumn("digest", F.unhex(F.md5("prompt")))
    classes = rows.groupBy("digest").agg(F.min("id").alias("cls"), F.bit_or("side").alias("sides"), F.first("prompt").alias("prompt"))
    classes = cut(classes)
    texts = cut(arrow_map(classes.select("cls", "sides", "prompt"), lambda: _canonical, "cls long, sides int, text string"))
    groups = cut(slip_groups(texts.select(F.explode(F.split("text", " ")).alias("word"))))
    tokens = _tokens_sent(texts, groups) if groups.count() <= most_sent else _tokens_joined(texts, groups)
    parts = _parts(tokens, part).repartition("part").sortWithinPartitions("part")
    links = parts.select("part", "cls", "sides", "block", "other", "text", "tokens").mapInArrow(_links(), "a long, b long, cover_a double, cover_b double")
    members = rows.select("id", "split", "source", "side", "digest").distinct().join(classes.select("digest", "cls", "sides"), "digest").join(texts.select("cls"), "cls", "left_semi")
    return members.select("id", "split", "source", "side", "cls", "sides"), links


def _calendar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members, and pairs of classes (cls_t, cls_h, cover of the held-out one), a class with rows of both sides among them."""
    members, links = cross_split(table(spark, sf_dir, "sft_calendar_v2"), "pair_id", "prompt", "split", "source")
    members, links = cut(members), cut(links)
    both = links.select(F.col("a").alias("cls_t"), F.col("b").alias("cls_h"), F.col("cover_b").alias("cover")).unionByName(links.select(F.col("b").alias("cls_t"), F.col("a").alias("cls_h"), F.col("cover_a").alias("cover")))
    equal = members.where("sides = 3").select(F.col("cls").alias("cls_t")).distinct().select("cls_t", F.col("cls_t").alias("cls_h"), F.lit(1.0).alias("cover"))
    return members, both.unionByName(equal)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id_a < pair_id_b of each training row and held-out row whose prompts make the same request."""
    members, pairs = _calendar(spark, sf_dir)
    train = members.where("side = 1").select(F.col("cls").alias("cls_t"), F.col("id").alias("id_t")).distinct()
    held = members.where("side = 2").select(F.col("cls").alias("cls_h"), F.col("id").alias("id_h")).distinct()
    rows = pairs.join(train, "cls_t").join(held, "cls_h").where("id_t != id_h")
    return rows.select(F.least("id_t", "id_h").alias("pair_id_a"), F.greatest("id_t", "id_h").alias("pair_id_b")).distinct()


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each held-out split, its source and the training source: pairs, held-out and training rows in them, and the pairs' mean coverage.

    Counted from the sizes of classes; the pairs of records are never made.
    """
    members, pairs = _calendar(spark, sf_dir)
    train = members.where("side = 1").groupBy(F.col("cls").alias("cls_t"), F.col("source").alias("train_source")).agg(F.count(F.lit(1)).alias("n_t"))
    held = members.where("side = 2").groupBy(F.col("cls").alias("cls_h"), "split", "source").agg(F.count(F.lit(1)).alias("n_h"))
    sized = cut(pairs.join(train, "cls_t").join(held, "cls_h"))
    by = ("split", "source", "train_source")
    n = F.col("n_t") * F.col("n_h")
    counts = sized.groupBy(*by).agg(F.sum(n).alias("n_pairs"), F.round(F.sum(F.col("cover") * n) / F.sum(n), 4).alias("mean_cover"))
    # a class counts once for each of the three, however many it is linked to
    held_rows = sized.groupBy("cls_h", *by).agg(F.first("n_h").alias("n")).groupBy(*by).agg(F.sum("n").alias("n_held_out"))
    train_rows = sized.groupBy("cls_t", *by).agg(F.first("n_t").alias("n")).groupBy(*by).agg(F.sum("n").alias("n_train"))
    out = counts.alias("c").join(held_rows.alias("h"), [F.col(f"c.{k}").eqNullSafe(F.col(f"h.{k}")) for k in by]).join(train_rows.alias("t"), [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by])
    return out.select(*(F.col(f"c.{k}").alias(k) for k in by), "n_pairs", "n_held_out", "n_train", "mean_cover")

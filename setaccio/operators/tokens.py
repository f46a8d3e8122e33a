"""Character vocabularies, token streams and training windows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from setaccio.operators.budget import prefix_sums

#: Distinct characters a vocabulary may have to be sent along as a map; Unicode has about 150 000 assigned ones.
MOST_CHARS = 200_000


def char_vocabulary(df: DataFrame, text_col: str) -> DataFrame:
    """char and its dense id, in order of code points, of every distinct character.

    Distinct characters are found before the shuffle; the numbering's one task gets at most one row a character of Unicode.
    """
    chars = df.where(F.col(text_col).isNotNull()).select(F.explode(F.array_distinct(F.split(text_col, ""))).alias("char")).where("char != ''").distinct()
    return chars.select("char", (F.row_number().over(Window.orderBy("char")) - 1).cast("int").alias("id"))


def vocabulary_map(vocabulary: DataFrame) -> dict[str, int]:
    """The vocabulary as a dict from character to id, of at most MOST_CHARS entries."""
    rows = vocabulary.limit(MOST_CHARS + 1).collect()
    if len(rows) > MOST_CHARS:
        raise ValueError(f"more than {MOST_CHARS} characters")
    return {r[0]: r[1] for r in rows}


def encode_chars(c: Column, vocabulary: dict[str, int]) -> Column:
    """Ids of a text's characters; unknown ones are dropped, null and empty texts give an empty list.

    An Arrow UDF: a look-up in a Spark map walks through its keys, so built-ins would cost the vocabulary's size a character.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [vocabulary[x] for x in t if x in vocabulary] if t else [])

    return encode(c)


def decode_chars(ids: Column, vocabulary: dict[str, int]) -> Column:
    """Text of ids; unknown ids give a question mark, null stays null."""
    characters = {i: c for c, i in vocabulary.items()}

    @F.pandas_udf(T.StringType())
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else "".join([characters.get(i, "?") for i in x]))

    return decode(ids)


def next_tokens(df: DataFrame, id_col: str, ids_col: str) -> DataFrame:
    """id, pos, token, next_token of every token that has a successor in its document."""
    tokens = df.select(F.col(id_col).alias("id"), F.posexplode(F.arrays_zip(F.col(ids_col).alias("t"), F.slice(F.col(ids_col), 2, F.greatest(F.size(ids_col), F.lit(1))).alias("n"))).alias("pos", "p"))
    return tokens.where("p.n is not null").select("id", "pos", F.col("p.t").alias("token"), F.col("p.n").alias("next_token"))


def windows(df: DataFrame, id_col: str, ids_col: str, length: int, step: int = 1) -> DataFrame:
    """id, start, x, y: each input window of `length` tokens and the same moved on by one; starts are 0, step, ... up to n - length - 2."""
    n = F.size(ids_col)
    starts = F.when(n - length - 2 >= 0, F.sequence(F.lit(0), n - length - 2, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("t"), F.explode(starts).alias("start"))
    return rows.select("id", "start", F.slice("t", F.col("start") + 1, length).alias("x"), F.slice("t", F.col("start") + 2, length).alias("y"))


def eval_windows(df: DataFrame, id_col: str, n_col: str, length: int, stride: int | None = None, mode: str = "reference") -> DataFrame:
    """id, begin, end, first_scored, n_scored: the sliding windows by which a stream of n tokens is scored.

    Windows begin at 0, stride, ... before n - 1; the first scores all its tokens but one. In mode `reference` a later one scores its last
    min(stride, size - 1), so tokens of the shortened windows at the end are scored again; in mode `exact` it scores only
    those that none before it has scored, and windows that would score none are left out.
    """
    stride = stride or length // 2
    n = F.col(n_col)
    starts = F.when(n >= 2, F.sequence(F.lit(0), (n - 2).cast("int"), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(id_col).alias("id"), n.alias("n"), F.explode(starts).alias("begin")).withColumn("end", F.least(F.col("begin") + length, F.col("n")).cast("int"))
    if mode == "reference":
        scored = F.when(F.col("begin") == 0, F.col("end") - F.col("begin") - 1).otherwise(F.least(F.lit(stride), F.col("end") - F.col("begin") - 1))
    elif mode == "exact":
        before = F.when(F.col("begin") == 0, 1).otherwise(F.least(F.col("begin") - stride + length, F.col("n")))
        scored = F.col("end") - before
    else:
        raise ValueError(f"no mode {mode}")
    return rows.withColumn("n_scored", scored.cast("int")).where("n_scored > 0").select("id", "begin", "end", (F.col("end") - F.col("n_scored")).cast("int").alias("first_scored"), "n_scored")


def probe_starts(df: DataFrame, id_col: str, n_col: str, length: int, n_probes: int, seed: int = 42) -> DataFrame:
    """id, probe, start: windows drawn with replacement from a stream's possible starts by a seeded hash; none of too short a stream."""
    span = F.col(n_col) - length - 1
    rows = df.where(span > 0).select(F.col(id_col).alias("id"), span.alias("span"), F.explode(F.sequence(F.lit(0), F.lit(n_probes - 1))).alias("probe"))
    return rows.select("id", "probe", F.pmod(F.xxhash64("id", "probe", F.lit(seed)), F.col("span")).alias("start"))


def probe_perplexity(df: DataFrame, id_col: str, losses_col: str, length: int, n_probes: int = 50, seed: int = 42) -> DataFrame:
    """id, n_probes, ppl: e to the mean, over a stream's probe windows, of the mean loss of the `length` tokens after each window's first; null if it is too short for one.

    losses_col: the loss of each token of a stream, an array.
    """
    streams = df.select(F.col(id_col).alias("id"), F.col(losses_col).alias("losses")).withColumn("n", F.size("losses"))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    start = lambda k: F.pmod(F.xxhash64("id", k, F.lit(seed)), F.greatest(F.col("n") - length - 1, F.lit(1))).cast("int")
    windows = F.transform(F.sequence(F.lit(0), F.lit(n_probes - 1)), lambda k: mean(F.slice("losses", start(k) + 2, length)))
    long = F.col("n") - length - 1 > 0
    return streams.select("id", F.when(long, F.lit(n_probes)).otherwise(0).alias("n_probes"), F.when(long, F.exp(mean(windows))).alias("ppl"))


#: Windows of one random batch.
MOST_DRAWS = 10_000


def random_batch(df: DataFrame, id_col: str, ids_col: str, length: int, n: int, seed: int = 42) -> DataFrame:
    """draw, id, start, x, y: n windows and the same moved on by one, drawn with replacement from all windows of all streams, each as likely.

    Draws are seeded hashes, so they can be repeated. An error if no stream is long enough or n is over MOST_DRAWS. Rows without an id are left out.
    """
    if n > MOST_DRAWS:
        raise ValueError(f"more than {MOST_DRAWS} draws")
    streams = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(ids_col).alias("t")).withColumn("n", F.greatest(F.size("t") - length - 1, F.lit(0)).cast("long"))
    placed = prefix_sums(streams.select("id", "n"), "id", "n").select("id", "before", "n")
    total = placed.agg(F.sum("n")).first()[0] or 0
    if not total:
        raise ValueError(f"no stream has {length + 2} tokens")
    drawn = df.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("place"))
    # n rows at most, so they can go to every task
    hits = placed.where("n > 0").join(F.broadcast(drawn), (F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
    rows = streams.select("id", "t").join(hits.select("id", "draw", (F.col("place") - F.col("before")).cast("int").alias("start")), "id")
    return rows.select("draw", "id", "start", F.slice("t", F.col("start") + 1, length).alias("x"), F.slice("t", F.col("start") + 2, length).alias("y"))


def pair_counts(df: DataFrame, ids_col: str) -> DataFrame:
    """left, right, n: how often each pair of tokens is adjacent, the count behind a byte-pair merge."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(ids_col) - 1), lambda i: F.struct(F.element_at(ids_col, i).alias("left"), F.element_at(ids_col, i + 1).alias("right")))
    return df.where(F.size(ids_col) >= 2).select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count(F.lit(1)).alias("n"))


def byte_pieces(vocabulary: DataFrame, score: float = -10000.0) -> DataFrame:
    """A vocabulary (id, piece, score) with a piece for each of the 256 bytes after it."""
    spark = vocabulary.sparkSession
    size = vocabulary.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("size")).scalar()
    extra = spark.range(256).withColumn("size", size).select((F.col("id") + F.col("size")).cast("int").alias("id"), F.format_string("<0x%02X>", "id").alias("piece"), F.lit(score).alias("score"))
    return vocabulary.select("id", "piece", "score").unionByName(extra)


class Tokenizer:
    """What the factory gives: encode of a text, and a key that tells whether ids of two of them can be mixed."""

    def __init__(self, name: str, key: str, make: Callable[[], Callable[[str], list[int]]]):
        self.name, self.key, self.make = name, key, make

    def encode(self, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """id_col and ids of every row; null and empty texts have an empty list. The tokenizer is loaded once a task."""
        make, kind = self.make, df.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            encode = make()
            for b in batches:
                yield pd.DataFrame({id_col: b["k"], "ids": [encode(t) if t else [] for t in b["t"]]})

        return df.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).mapInPandas(run, f"`{id_col}` {kind}, ids array<int>")


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _sentencepiece(path: str):
    def make():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode

    return make


def _ranks(path: str, pattern: str):
    def make():
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


def tokenizer(kind: str, source: str, pattern: str | None = None) -> Tokenizer:
    """By kind: `chars` (source is the characters), `sentencepiece` (a model file) or `ranks` (a rank file, with its pattern)."""
    if kind == "chars":
        ids = {c: i for i, c in enumerate(sorted(set(source)))}
        return Tokenizer("chars", "".join(sorted(ids)), lambda: lambda t: [ids[c] for c in t if c in ids])
    if kind == "sentencepiece":
        return Tokenizer("sentencepiece", _digest(source), _sentencepiece(source))
    if kind == "ranks":
        return Tokenizer("ranks", _digest(source), _ranks(source, pattern or r"\S+|\s+"))
    raise ValueError(f"no tokenizer {kind}")

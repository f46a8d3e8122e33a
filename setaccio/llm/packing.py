"""Problem 7: filling windows of fixed capacity with texts, by best-fit decreasing.

Only ids and sizes are shuffled, to shares by a hash of id and text, so neither the layout of files nor the number of tasks changes the result.
A share has about `SHARE` texts. Best fit looks for the tightest open window by a segment tree over remaining capacities, in logarithmic time per text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import Encoder, vocabulary
from .common import arrow_map, table

#: Texts that are packed together, about. Equal rows are in one share; of a share that so many of them make `MOST` times as large, parts are packed one after another.
SHARE, MOST = 50_000, 4


class OpenBins:
    """Open bins by remaining capacity: a segment tree whose leaf r counts the bins with r left."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, number: int) -> None:
        self.bins[left].append(number)
        i = left + self.width
        while i:
            self.tree[i] += 1
            i >>= 1

    def tightest(self, size: int) -> int:
        """The least remaining capacity >= size of an open bin; -1 if none has it."""
        i = size + self.width
        if i >= len(self.tree):
            return -1
        if not self.tree[i]:
            while i & 1 or not self.tree[i + 1]:
                i >>= 1
                if i <= 1:
                    return -1
            i += 1
            while i < self.width:
                i *= 2
                if not self.tree[i]:
                    i += 1
        return i - self.width

    def take(self, left: int) -> int:
        i = left + self.width
        while i:
            self.tree[i] -= 1
            i >>= 1
        return self.bins[left].pop()


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(bin of each item, number of bins); sizes are 1 to capacity. Equal sizes are taken in their order."""
    open_bins, where, bins = OpenBins(capacity), np.empty(len(sizes), dtype=np.int64), 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        left = open_bins.tightest(size)
        if left < 0:
            number, left, bins = bins, capacity, bins + 1
        else:
            number = open_bins.take(left)
        where[k] = number
        if left > size:
            open_bins.add(left - size, number)
    return where, bins


def _pack(ids: list, sizes: np.ndarray, window: tuple[int, int], base: int) -> tuple[dict, int]:
    """Rows of one share and one window, and the number of bins used."""
    window_id, capacity = window
    full, rest = sizes // capacity, sizes % capacity
    has = np.flatnonzero(rest)
    where, bins = best_fit_decreasing(rest[has], capacity)
    of = np.concatenate((has, np.repeat(np.arange(len(sizes)), full)))
    piece = np.concatenate((full[has], np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full)))
    n = len(of)
    cols = {
        "window_id": pa.array(np.full(n, window_id), type=pa.int32()),
        "id": pa.array(ids).take(pa.array(of)),
        "piece": pa.array(piece, type=pa.int64()),
        "first_token": pa.array(piece * capacity, type=pa.int64()),
        "n_tokens": pa.array(np.concatenate((rest[has], np.full(n - len(has), capacity))), type=pa.int64()),
        "bin_id": pa.array(base + np.concatenate((where, bins + np.arange(n - len(has)))), type=pa.int64()),
    }
    return cols, bins + n - len(has)


def pack(df: DataFrame, id_col: str, text_col: str, windows: list[tuple[int, int]], vocabulary_path: str, share: int = SHARE) -> DataFrame:
    """id_col, window_id, piece, first_token, n_tokens, bin_id: the bin of each text, for each (window_id, capacity).

    A text no longer than the capacity is one piece (0). A longer one is cut into full pieces, a bin each, and a rest that is packed
    like any text. Null and empty texts, and those without a token, are left out. Rows repeated under one id, or without an id,
    are items of their own. Windows whose capacity isn't positive are an error. bin_id is unique over a window_id;
    no bin holds more than its capacity. An empty table gives no rows. The result depends on the rows alone: of equal sizes the lower id comes first.
    """
    if any(c is None or c <= 0 for _, c in windows):
        raise ValueError("a window's capacity must be positive")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"window_id int, `{id_col}` {kind}, piece bigint, first_token bigint, n_tokens bigint, bin_id bigint"

    def counted():
        encoder = Encoder(vocabulary_path)

        def f(batch: pa.RecordBatch) -> dict:
            n = pa.array([encoder.count(t) for t in batch.column("t").to_pylist()], type=pa.int64())
            return {"k": batch.column("k"), "h": batch.column("h"), "n": n}

        return f

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = [TaskContext.get().partitionId() << 33] * len(windows)
        ids, sizes = [], []

        def share_of() -> Iterator[pa.RecordBatch]:
            for k, window in enumerate(windows):
                cols, bins = _pack(ids, np.array(sizes, dtype=np.int64), window, base[k])
                base[k] += bins
                names = [id_col if c == "id" else c for c in cols]
                yield from pa.Table.from_arrays(list(cols.values()), names=names).to_batches(max_chunksize=100_000)
            ids.clear()
            sizes.clear()

        for batch in batches:
            ids += batch.column("k").to_pylist()
            sizes += batch.column("n").to_pylist()
            if len(sizes) >= MOST * share:
                yield from share_of()
        if sizes:
            yield from share_of()

    n_shares = max(1, -(-df.count() // share))
    texts = df.select(df[id_col].alias("k"), df[text_col].alias("t")).where("t is not null and t != ''").withColumn("h", F.xxhash64("t"))
    items = arrow_map(texts, counted, f"k {kind}, h long, n long").where("n > 0")
    shares = items.repartitionById(n_shares, F.pmod(F.xxhash64("k", "h"), F.lit(n_shares)).cast("int")).sortWithinPartitions(F.desc("n"), "k", "h")
    return shares.select("k", "n").mapInArrow(packed, schema)


def _windows(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """The capacities, a table of a few rows at every scale."""
    rows = table(spark, sf_dir, "pack_windows").select("window_id", "capacity_tokens").orderBy("window_id").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("pack_windows has more than 1000 rows")
    return [tuple(r) for r in rows]


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of each document, or of each of its pieces, for each window of pack_windows."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", _windows(spark, sf_dir), vocabulary("byte_bpe_50k"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each window: pieces, tokens, bins, the fewest bins that could hold the tokens, and the share of space used."""
    windows = table(spark, sf_dir, "pack_windows").select("window_id", "capacity_tokens")  # no more rows than _windows allows
    bins = p7_bins(spark, sf_dir).groupBy("window_id", "bin_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
    total = bins.groupBy("window_id").agg(F.sum("n_pieces").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_bins"), F.max("n_tokens").alias("fullest"))
    return total.join(F.broadcast(windows), "window_id").select(
        "window_id", "capacity_tokens", "n_pieces", "n_tokens", "n_bins", "fullest",
        F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("fewest_bins"),
        F.round(F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")), 6).alias("fill"),
    )

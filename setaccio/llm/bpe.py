"""Problem 6: encoding texts with a byte-level BPE vocabulary given as ranks.

Words are found by the vocabulary's pattern and merged by a contiguous array of part boundaries and one of the ranks
of adjacent pairs: scan for the lowest rank, delete that boundary, refresh the two neighbouring ranks. Words over
`SHORT` bytes, where scanning would cost the square of the length, take the same merges from a heap.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

#: Where the public vocabularies are; every operator takes another path as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes up to which a word is merged by scanning.
SHORT = 128
#: Words whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000
#: Texts of more characters are matched word by word instead of being split at once.
AT_ONCE = 2_000_000

_NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank, which is also the id, of each byte sequence of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    bounds = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], _NONE) for i in range(len(word) - 1)]
    while near:
        low = min(near)
        if low == _NONE:
            break
        i = near.index(low)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NONE)
        if i:
            near[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges (lowest rank first, leftmost among equals) by a heap over linked parts."""
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here; 0 if none does
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or not end[middle] or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (left := before[i]) >= 0 and (r := ranks.get(word[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Words(dict):
    """Ids of words, worked out when first asked for."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else (merge_short if len(raw) <= SHORT else merge_long)(raw, self.ranks)
        if len(raw) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts by a .tiktoken vocabulary; strings like special tokens are ordinary text."""

    def __init__(self, path: str):
        self.ids = _Words(load_ranks(path))
        self.split = regex.compile(PATTERN)

    def _words(self, text: str):
        return self.split.findall(text) if len(text) <= AT_ONCE else (m[0] for m in self.split.finditer(text))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, self._words(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.ids.__getitem__, self._words(text)))) if text else 0


def vocabulary(name: str, folder: str | None = None) -> str:
    return f"{folder or TOKENIZERS}/{name}.tiktoken"


def encode(df: DataFrame, id_col: str, text_col: str, vocabulary_path: str) -> DataFrame:
    """id_col and ids (a list of integers, without special tokens) of every row.

    Null and empty texts have an empty list. Rows are neither dropped nor merged: null and repeated ids stay as they are.
    Blank texts are encoded like any others, texts of any length as a whole. Other columns, whatever their names, are not read.
    """

    def make():
        encoder = Encoder(vocabulary_path)

        def f(batch: pa.RecordBatch) -> dict:
            lists = [np.array(encoder.encode(t), dtype=np.int32) for t in batch.column("t").to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            return {id_col: batch.column("k"), "ids": pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(np.concatenate(lists)))}

        return f

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(df[id_col].alias("k"), df[text_col].alias("t")), make, f"`{id_col}` {kind}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the ids by byte_bpe_50k of every document."""
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary("byte_bpe_50k"))

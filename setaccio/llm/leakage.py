"""Problem 4: evaluation passages inside training text, by spaced seeds.

A mask of 12 token positions ignores some of them. The hashes of all masked windows of the passages form a table of bounded
size; each corpus text is read once and its masked windows are looked up in it. A hit gives a passage and a diagonal (the
difference of the two positions), and the two texts are compared along it: the best stretch with substitutions, and the longest
run without any. A run of 12 equal words agrees under every mask, so no such run is missed.

The corpus is never shuffled. Passages beyond the bound are taken in blocks, each of which is one pass over the corpus.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, keyed, table, texts_of
from .wordhash import blocks, decompose, mix, word_hashes

#: Token positions that count (1) and that may differ (0).
MASKS = ("111010010111", "110110110011", "101110011101", "111100001111")
SPAN = len(MASKS[0])
#: Characters of passages that are sent to the executors at once; about 60 MB of tables.
PASSAGE_CHARS = 4_000_000
#: Score of an equal and of a substituted word in the best stretch of a diagonal.
SAME, OTHER = 1, -2

#: A tag may be long and go on over line ends.
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_HYPHENS = "".join(map(chr, (0x2D, 0x2010, 0x2011)))
_BROKEN = re.compile(rf"(?<=[^\W_])[{_HYPHENS}][^\S\r\n]*\r?\n[^\S\r\n]*(?=[^\W\d_])")
#: Code points of no width or without a glyph; line ends, tabs and the other blanks aren't among them.
UNSEEN = ((0x0, 0x8), (0xE, 0x1B), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))
_INVISIBLE = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in UNSEEN) + "]+")


def plain(text: str) -> str:
    """Text without markup, invisible characters and breaks of words at line ends, in lower case and decomposed."""
    if not text.isascii() or "\x7f" in text or not text.isprintable():
        text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if "[[" in text:
        text = _LINK.sub(r"\1", text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return decompose(text)


def _seeds(words: np.ndarray, offsets: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Masked hashes of all windows that lie in one text, and the positions of their first words."""
    counts = np.maximum(np.diff(offsets) - SPAN + 1, 0)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = max(0, len(words) - SPAN + 1)
    h = np.full(total, mask + 1, dtype=np.uint64)
    for j, on in enumerate(MASKS[mask]):
        if on == "1":
            h += words[j : j + total] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 % 2**64 | 1)
    inside = np.repeat(offsets[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return mix(h)[inside], inside


class Passages:
    """The masked windows of a block of passages, ready for look-ups."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words, self.offsets = word_hashes([plain(r[1]) for r in rows])
        found = [_seeds(self.words, self.offsets, m) for m in range(len(MASKS))]
        keys, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(keys, kind="stable")
        self.keys, self.at = keys[order], at[order]
        bits = max(16, 4 * len(keys)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self.keys >> self.shift] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of (index in keys, word position in the passages)."""
        some = np.flatnonzero(self.maybe[keys >> self.shift])
        lo, hi = (np.searchsorted(self.keys, keys[some], side) for side in ("left", "right"))
        n = hi - lo
        pos = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(some, n), self.at[pos]


def _longest_run(same: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.astype(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _best_stretch(same: np.ndarray) -> tuple[int, int]:
    """Begin and end of the stretch of greatest score."""
    score = np.concatenate(([0], np.cumsum(np.where(same, SAME, OTHER))))
    gain = score - np.minimum.accumulate(score)
    end = int(gain.argmax())
    begin = int(np.flatnonzero(score[: end + 1] == score[: end + 1].min())[-1])
    return begin, end


def _overlaps(ids: list, texts: list[str], p: Passages) -> list[tuple]:
    out = []
    for lo, hi in blocks(texts):
        words, offsets = word_hashes([plain(t) for t in texts[lo:hi]])
        spots = []
        for m in range(len(MASKS)):
            keys, at = _seeds(words, offsets, m)
            k, there = p.hits(keys)
            spots.append(np.stack((at[k], there)))
        here, there = np.concatenate(spots, axis=1)
        if not len(here):
            continue
        doc = np.searchsorted(offsets, here, side="right") - 1
        passage = np.searchsorted(p.offsets, there, side="right") - 1
        for d, q, shift in np.unique(np.stack((doc, passage, here - there), axis=1), axis=0).tolist():
            begin = max(int(offsets[d]), int(p.offsets[q]) + shift)
            end = min(int(offsets[d + 1]), int(p.offsets[q + 1]) + shift)
            same = words[begin:end] == p.words[begin - shift : end - shift]
            a, b = _best_stretch(same)
            out.append((ids[lo + d], p.ids[q], begin + a - int(offsets[d]), begin + a - shift - int(p.offsets[q]), b - a, int(same[a:b].sum()), _longest_run(same)))
    return out


def _blocks(passages: DataFrame) -> int:
    """Number of hash shares of the passages, none of which has more than PASSAGE_CHARS characters but for one passage that has by itself."""
    total, longest, n = passages.agg(F.coalesce(F.sum(F.length("c0")), F.lit(0)), F.coalesce(F.max(F.length("c0")), F.lit(0)), F.count_distinct("id")).first()
    blocks = max(1, -(-total // PASSAGE_CHARS))
    while 1 < blocks < n:
        share = passages.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks))).agg(F.sum(F.length("c0")).alias("s")).agg(F.max("s")).first()[0]
        if share <= max(PASSAGE_CHARS, longest):
            break
        blocks = min(n, blocks + -(-blocks // 4))
    return blocks


def overlaps(corpus: DataFrame, id_col: str, text_col: str, passages: DataFrame, passage_id: str, passage_text: str) -> DataFrame:
    """One row for each corpus text, passage and diagonal on which a masked window agrees.

    id, passage_id; first_word, passage_word (where the best stretch begins in each); n_words and n_same of that stretch;
    longest_run (most consecutive equal words on the diagonal, so n_words - n_same substitutions in the stretch).
    Words are runs of letters or digits, without case, accents, markup, invisible characters and breaks at line ends.
    Null and empty texts, texts and passages of fewer than 12 words, and rows without an id give no rows. Rows repeated
    under one id give their rows again. Passages without text in common and empty tables give an empty result.
    """
    corpus, passages = keyed(corpus, id_col, text_col), keyed(passages, passage_id, passage_text).where("c0 is not null")
    n_blocks = _blocks(passages)
    parts = []
    for k in range(n_blocks):
        block = passages if n_blocks == 1 else passages.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == k)
        sent = corpus.sparkSession.sparkContext.broadcast([tuple(r) for r in block.orderBy("id").collect()])

        def make(sent=sent):
            table = Passages(sent.value)
            names = ("id", "passage_id", "first_word", "passage_word", "n_words", "n_same", "longest_run")

            def f(batch: pa.RecordBatch) -> dict:
                rows = _overlaps(batch.column("id").to_pylist(), texts_of(batch, "c0"), table)
                return {c: [r[i] for r in rows] for i, c in enumerate(names)}

            return f

        kinds = [d.schema["id"].dataType.simpleString() for d in (corpus, passages)]
        parts.append(arrow_map(corpus, make, f"id {kinds[0]}, passage_id {kinds[1]}, first_word int, passage_word int, n_words int, n_same int, longest_run int"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "wiki_it"), "row_id", "text", table(spark, sf_dir, "wiki_probe"), "probe_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id and probe_id whose texts have twelve or more consecutive words in common."""
    return _wiki(spark, sf_dir).where(F.col("longest_run") >= 12).select(F.col("id").alias("row_id"), F.col("passage_id").alias("probe_id")).distinct()


def p4_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every substitution-tolerant overlap of twelve words or more with at most a quarter of them substituted."""
    found = _wiki(spark, sf_dir).where("n_words >= 12 and 4 * n_same >= 3 * n_words")
    return found.select(F.col("id").alias("row_id"), F.col("passage_id").alias("probe_id"), "first_word", "passage_word", "n_words", "n_same", "longest_run")


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each leaked probe: the articles that hold twelve or more of its words in a row, and its longest run."""
    found = _wiki(spark, sf_dir).where(F.col("longest_run") >= 12).groupBy("id", "passage_id").agg(F.max("longest_run").alias("longest_run"))
    return found.groupBy(F.col("passage_id").alias("probe_id")).agg(F.count(F.lit(1)).alias("n_articles"), F.max("longest_run").alias("longest_run"))

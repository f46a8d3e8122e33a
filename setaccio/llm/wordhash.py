"""Vectorised words, word hashes and shingle hashes of many texts at once.

A block of texts is folded, joined and turned into one array of code points;
words are found and hashed by whole-array numpy operations, so the cost per
character is a few nanoseconds and no Python loop runs over words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np

#: Code points a block holds at most (a single longer text is a block by itself); its arrays then stay in the cache of a core.
BLOCK_CHARS = 60_000

_U = np.uint64
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1

_tables: dict[str, np.ndarray] = {}


def decompose(text: str) -> str:
    """Case folded and decomposed; the marks are left in, for word_hashes to drop."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text.casefold())


def fold(text: str) -> str:
    """Lower case without accents: case folding, compatibility decomposition, no combining marks."""
    parts = decompose(text)
    return parts if parts.isascii() else "".join(c for c in parts if not unicodedata.combining(c))


def _word_table() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    if "word" not in _tables:
        _tables["word"] = np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["word"]


def _digit_table() -> np.ndarray:
    """Whether each code point is a digit."""
    if "digit" not in _tables:
        _tables["digit"] = np.fromiter((chr(i).isdigit() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["digit"]


def _mark_table() -> np.ndarray:
    """Whether each code point is a combining mark."""
    if "mark" not in _tables:
        _tables["mark"] = np.fromiter((unicodedata.combining(chr(i)) > 0 for i in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["mark"]


def _powers(n: int) -> np.ndarray:
    have = _tables.get("pow")
    if have is None or len(have) < n:
        size = max(64, 1 << (n - 1).bit_length())
        factors = np.full(size, _BASE, dtype=np.uint64)
        factors[0] = 1
        have = np.multiply.accumulate(factors)
        _tables["pow"] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


def _no_words(offsets: np.ndarray, details: bool) -> tuple[np.ndarray, ...]:
    return (np.zeros(0, np.uint64), offsets, *((np.zeros(0, np.int64), np.zeros(0, np.int64)) if details else ()))


def word_hashes(texts: list[str], details: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of each word, in order; offsets: text k has the words offsets[k]:offsets[k + 1]).

    The texts are folded or decomposed; combining marks are dropped here. With details, also how many letters and digits together,
    and how many digits, each word has.
    """
    joined = "\0".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    if not len(cp):
        return _no_words(np.zeros(len(texts) + 1, np.int64), details)
    marks = _mark_table()[cp]
    if marks.any():
        kept = np.concatenate(([0], np.cumsum(~marks), [0]))
        kept[-1] = kept[-2] + 1
        cp, ends = cp[~marks], kept[ends]
        if not len(cp):
            return _no_words(np.zeros(len(texts) + 1, np.int64), details)
    inside = _word_table()[cp]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & ~before)
    offsets = np.concatenate(([0], np.searchsorted(starts, ends - 1)))
    if not len(starts):
        return _no_words(offsets, details)
    where = np.flatnonzero(inside)
    first = np.flatnonzero(~before[where])
    sizes = np.diff(np.append(first, len(where)))
    at = np.arange(len(where)) - np.repeat(first, sizes)
    value = cp[where].astype(np.uint64) * _powers(int(sizes.max()))[at]
    hashes = mix(np.add.reduceat(value, first) + sizes.astype(np.uint64))
    if not details:
        return hashes, offsets
    digits = np.add.reduceat(_digit_table()[cp[where]].astype(np.int64), first)
    return hashes, offsets, sizes, digits


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each text, and their offsets by text."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    total = int(out[-1])
    if not total:
        return np.zeros(0, np.uint64), out
    at = np.arange(total) + np.repeat(offsets[:-1] - out[:-1], counts)
    h = words[at].copy()
    for k in range(1, n):
        h = mix(h * _U(_BASE) + words[at + k])
    return h, out


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of together at most `most` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)

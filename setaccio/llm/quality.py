"""Problem 1: statistics of each text, and the kind of those that aren't prose.

Words, common words and letter trigrams are counted for all lines of a block of texts at once; repetition statistics
come from one sort a block of (text, n-gram) keys. The rules that combine them work on the counts of each text's lines.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, keyed, table, texts_of
from .wordhash import blocks, decompose, fold, shingle_hashes, word_hashes

#: Rows that samples and word lists may have together; they are read on the driver.
MOST_SAMPLES = 20_000
#: Items with which a text is a list although most of it is its one sentence of introduction.
FEW = 4
#: Lengths of the n-grams whose commonest is measured.
NGRAMS = (2, 3, 4)
#: Share of a text's letters that its commonest n-gram may hold before the text is the same over and over.
MOST_COVERED = {2: 0.5, 3: 0.45, 4: 0.4}
#: Words of the lines that sites put around their texts; a line of up to `FURNITURE_WORDS` words with two of them is boilerplate.
FURNITURE = (
    "cookie", "cookies", "biscotti", "javascript", "copyright", "privacy", "newsletter", "login", "homepage", "menu", "sito", "pagina", "iniziale", "archivio", "redazione", "commento", "commenti",
    "condividi", "iscriviti", "accedi", "registrati", "clicca", "leggi", "torna", "diritti", "riservati", "notizie", "preferenze",
)
FURNITURE_WORDS = 14

_ENDS = ".!?…:;»\"”’')"
_STOPS = ".!?…"
#: What begins a line of dialogue; with a full stop it begins no item.
_DASHES = "–—«"
_ITEM = re.compile(r"\s*(?:[-*+•◦▪‣·»–—]|\(?\d{1,3}[.)°]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)]|\[[ xX]?\])\s+\S")
_BLANK_LINE = re.compile(r"\n\s*\n")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_SENTENCE = re.compile(r"[^\W\d_]{2,}[»”\")]*[.!?…]+[»”\")]*(?=\s+[«“\"(–—]*[A-ZÀ-Þ]|\s*$)")
#: Separators of a table's fields; a list's items are separated by the same or by INLINE ones.
FIELDS = ("|", "\t", ";", '","', " - ", ",", " / ")
INLINE = (" » ", " · ", " | ", " • ", " / ", "; ", ", ")

STATISTICS = {
    "n_chars": "int", "n_words": "int", "n_lines": "int", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double", "punctuated_lines": "double",
    "common_words": "double", "known_trigrams": "double", "mixed_words": "double", "duplicate_lines": "double", "n_paragraphs": "int", "duplicate_paragraphs": "double", "boilerplate": "double",
    "top_2gram": "double", "top_3gram": "double", "top_4gram": "double", "table_share": "double", "list_share": "double", "kind": "string",
}


class Language:
    """What is known of written language: hashes of common words, and the letter trigrams of sample texts."""

    def __init__(self, common: list[str], samples: list[str]):
        self.common = np.unique(word_hashes([fold(w) for w in common])[0])
        self.furniture = np.unique(word_hashes([fold(w) for w in FURNITURE])[0])
        self.letters = frozenset(w for w in map(fold, common) if len(w) == 1)
        self.known = np.zeros(1 << 15, dtype=bool)
        codes, _, inner = _trigrams([decompose(t) for t in [*samples, *common]])
        self.known[codes[inner]] = True

    def is_common(self, words: np.ndarray) -> np.ndarray:
        return _among(words, self.common)


def _among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each hash is one of the known, sorted ones."""
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return known[at] == words if len(known) else np.zeros(len(words), bool)


_classes: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """0 no letter, 1-26 a-z, 27 another letter, 28 a digit, 31 a combining mark (to be dropped)."""
    if not _classes:
        import unicodedata

        t = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                t[i] = i - 96 if 97 <= i <= 122 else 27
            elif c.isalnum():
                t[i] = 28
            elif unicodedata.combining(c):
                t[i] = 31
        _classes.append(t)
    return _classes[0]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram codes; offsets by text; whether each is centred on a letter)."""
    cp = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cls = _class_table()[cp]
    kept = cls != 31
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
    if not kept.all():
        ends = np.cumsum(kept)[ends] - 1
        cls = cls[kept]
    cls = cls.astype(np.int32)
    offsets = np.minimum(np.concatenate(([0], ends)), max(len(cls) - 2, 0))
    return (cls[:-2] << 10) | (cls[1:-1] << 5) | cls[2:], offsets, (cls[1:-1] > 0) & (cls[1:-1] < 28)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(values)))[offsets])


def _top_coverage(words: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """For each text: the share of its words' letters that the occurrences of its commonest n-gram hold (0 if none repeats)."""
    grams, at = shingle_hashes(words, offsets, n)
    out = np.zeros(len(offsets) - 1)
    if not len(grams):
        return out
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    cum = np.concatenate(([0], np.cumsum(sizes)))
    first = np.repeat(offsets[:-1] - at[:-1], np.diff(at)) + np.arange(len(grams))
    key = (doc.astype(np.uint64) << np.uint64(44)) | (grams >> np.uint64(20))
    order = np.argsort(key, kind="stable")
    key, begin = key[order], first[order]
    same = np.concatenate((key[1:] == key[:-1], [False]))
    # an occurrence ends where the next one begins, so letters that two of them hold count once
    end = np.where(same, np.minimum(begin + n, np.append(begin[1:], 0)), begin + n)
    edge = np.flatnonzero(np.concatenate(([True], ~same[:-1])))
    count, held = np.diff(np.append(edge, len(key))), np.add.reduceat(cum[end] - cum[begin], edge)
    total = np.maximum(cum[offsets[1:]] - cum[offsets[:-1]], 1)
    of = (key[edge] >> np.uint64(44)).astype(np.int64)
    np.maximum.at(out, of, np.where(count > 1, held / total[of], 0.0))
    return out


def _table_share(raw: list[str], sizes: np.ndarray, whole: int) -> float:
    """Share of the text's characters (`whole`) that stand in rows of the same fields."""
    if len(raw) < 3:
        return 0.0
    best = 0.0
    text = "\n".join(raw)
    for sep in FIELDS:
        if text.count(sep) < 3:
            continue
        counts = [(line if line.count(sep) > 1 else line.rstrip(" ;")).count(sep) for line in raw]
        most, n = max(((c, k) for c, k in Counter(counts).items() if c), key=lambda x: (x[1], x[0]), default=(0, 0))
        if n < 3 or most < (3 if sep in (",", " / ") else 2 if sep in (" - ", '","') else 1) or most == 1 and n < 4:
            continue
        rows = np.array([c == most for c in counts])
        if sep == "," and sum(", " in line for line, r in zip(raw, rows) if r) * 2 > n:
            continue
        if most == 1 and sep == ";" and sum(bool(_SENTENCE.search(line)) for line in raw) * 2 > n:
            continue
        best = max(best, min(1.0, float(sizes[rows].sum() / whole)))
    if text.count("  ") < 3:
        return best
    gaps = [len(_GAP.findall(line)) for line in raw]
    rows = np.array([g >= 1 for g in gaps])
    if rows.sum() >= 3 and sum(gaps) >= 1.5 * rows.sum() and sum(len(_GAP.split(line)) * 4 >= len(line.split()) for line in raw) * 2 > len(raw):
        best = max(best, min(1.0, float(sizes[rows].sum() / whole)))
    return best


def _list_share(lines: list[str], sizes: np.ndarray, words: np.ndarray, common: np.ndarray, letters: frozenset[str], boilerplate: np.ndarray) -> tuple[float, int, int]:
    """(share of the characters that stand in items; items; sentences outside them, counted where it matters). Boilerplate is neither."""
    items = np.zeros(len(lines), dtype=bool)
    n_items = 0
    for i, line in enumerate(lines):
        w, c = int(words[i]), int(common[i])
        stopped = line[-1] in _STOPS
        bullet = _ITEM.match(line)
        if bullet and (mark := bullet[0].strip()[:-1].strip(" ()[].°")) and mark.isalnum():
            w, c = w - 1, c - (mark.lower() in letters)  # the mark isn't a word of the item
        if bullet and w <= 9 and (c <= 0.3 * w or w <= 4 and not stopped) and not (stopped and (w >= 5 and line[-1] != "." or line[0] in _DASHES)):
            items[i] = True
            n_items += 1
            continue
        for sep in INLINE:
            n = line.count(sep) + 1
            if n >= 4 and w <= (4.5 if sep in (", ", "; ") else 7) * n and c <= (0.2 if sep in (", ", "; ") else 0.3) * w and not len(_SENTENCE.findall(line)) > 1:
                items[i] = True
                n_items += n
                break
    plain = np.flatnonzero(~items)
    short = np.array([words[i] <= 7 and lines[i][-1] not in ".!?…:," and len(lines[i]) <= 60 for i in plain.tolist()], dtype=bool)
    if short.sum() >= 5:
        rest = plain[int(short.argmax()) :]  # from the first short line on
        short = short[len(short) - len(rest) :]
        if short.mean() >= 0.85 and words[rest].mean() <= 4.6 and common[rest].sum() <= 0.22 * words[rest].sum():
            items[rest] = True
            n_items += len(rest)
    counted = np.array([items[i] or not boilerplate[i] and (lines[i][-1] != ":" or words[i] > 8) for i in range(len(lines))])
    total = sizes[counted].sum()
    share = float(sizes[items].sum() / total) if total else 0.0
    if n_items < FEW or share >= 0.5:
        return share, n_items, 0
    outside = [i for i in np.flatnonzero(~items & ~boilerplate).tolist() if lines[i][-1] != ":" and words[i] > 4]
    return share, n_items, sum(max(1, len(_SENTENCE.findall(lines[i]))) for i in outside)


def _kind(s: dict, n_items: int, sentences: int) -> str:
    """The name of a text's kind by its statistics: prose, list, table or junk; blank if there is nothing to read."""
    if not s["n_chars"]:
        return "blank"
    if s["n_lines"] >= 4 and s["duplicate_lines"] > 0.5 or s["n_paragraphs"] >= 4 and s["duplicate_paragraphs"] > 0.5:
        return "junk"
    if s["n_words"] >= 12 and any(s[f"top_{n}gram"] > most for n, most in MOST_COVERED.items()):
        return "junk"
    if s["table_share"] >= 0.5 and (s["known_trigrams"] >= 0.7 or s["digit_ratio"] >= 0.4):
        return "table"
    if s["n_chars"] >= 20 and (s["n_words"] < 0.04 * s["n_chars"] and s["symbol_ratio"] > 0.4 or s["n_words"] and s["known_trigrams"] < 0.74):
        return "junk"
    if s["n_words"] >= 5 and s["mixed_words"] > 0.25 or s["symbol_ratio"] > 0.45 and s["n_chars"] >= 20:
        return "junk"
    if s["n_words"] >= 10 and s["mean_word_length"] < 1.8:
        return "junk"
    if n_items >= 4 and (s["list_share"] >= 0.5 or n_items >= FEW and sentences <= 1):
        return "list"
    return "prose"


def describe(texts: list[str], language: Language) -> list[dict]:
    """The statistics of each text."""
    raws = [[x for x in t.splitlines() if x and not x.isspace()] for t in texts]
    lines = [[x.strip() for x in raw] for raw in raws]
    flat = [decompose(x) for own in lines for x in own]
    line_at = np.cumsum([0, *map(len, lines)])
    words, word_at, sizes, digits = word_hashes(flat, details=True) if flat else (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    mixed = (digits > 0) & (digits < sizes)
    common = _sums(language.is_common(words), word_at)
    line_words = np.diff(word_at)
    furniture = (_sums(_among(words, language.furniture), word_at) >= 2) & (line_words <= FURNITURE_WORDS)
    codes, code_at, inner = _trigrams(flat)
    known, letters = _sums(language.known[codes] & inner, code_at), _sums(inner, code_at)
    doc_at = word_at[line_at]
    top = {n: _top_coverage(words, sizes, doc_at, n) for n in NGRAMS}
    by_doc = {k: np.diff(np.concatenate(([0], np.cumsum(v)))[line_at]) for k, v in (("common", common), ("known", known), ("letters", letters))}
    n_words, n_mixed, n_alnum, n_digits = np.diff(doc_at), _sums(mixed, doc_at), _sums(sizes, doc_at), _sums(digits, doc_at)
    out = []
    for k, (text, raw, own) in enumerate(zip(texts, raws, lines)):
        a, b = line_at[k], line_at[k + 1]
        width = np.array([len(x) for x in own], dtype=np.int64)
        solid = sum(map(len, text.split()))
        n = int(n_words[k])
        paragraphs = [p for p in (x.strip() for x in _BLANK_LINE.split(text)) if p] if "\n" in text else []
        boilerplate = furniture[a:b]
        around = int(width[boilerplate].sum())
        s = {
            "n_chars": solid, "n_words": n, "n_lines": len(own),
            "mean_word_length": float(n_alnum[k] / n) if n else 0.0,
            "symbol_ratio": max(0.0, 1 - int(n_alnum[k]) / solid) if solid else 0.0,
            "digit_ratio": min(1.0, int(n_digits[k]) / solid) if solid else 0.0,
            "punctuated_lines": sum(x[-1] in _ENDS for x in own) / len(own) if own else 0.0,
            "common_words": float(by_doc["common"][k] / n) if n else 0.0,
            "known_trigrams": float(by_doc["known"][k] / by_doc["letters"][k]) if by_doc["letters"][k] else 0.0,
            "mixed_words": float(n_mixed[k] / n) if n else 0.0,
            "duplicate_lines": 1 - len(set(own)) / len(own) if own else 0.0,
            "n_paragraphs": len(paragraphs), "boilerplate": around / int(width.sum()) if own else 0.0,
            "duplicate_paragraphs": 1 - len(set(paragraphs)) / len(paragraphs) if paragraphs else 0.0,
            "top_2gram": float(top[2][k]), "top_3gram": float(top[3][k]), "top_4gram": float(top[4][k]),
            "table_share": _table_share(raw, width, max(1, int(width.sum()) - around)) if own else 0.0,
        }
        s["list_share"], items, sentences = _list_share(own, width, line_words[a:b], common[a:b], language.letters, boilerplate) if own else (0.0, 0, 0)
        s["kind"] = _kind(s, items, sentences)
        out.append(s)
    return out


def _bounded(df: DataFrame, *cols: str) -> list:
    rows = df.select(*cols).where(" and ".join(f"{c} is not null" for c in cols)).orderBy(*cols).limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} rows of samples")
    return rows


def known_language(spark: SparkSession, sf_dir: str) -> Language:
    """From the word list and the clean sample texts, small tables of the same size at every scale."""
    samples = [r[0] for name in ("lang_samples", "reading_samples") for r in _bounded(table(spark, sf_dir, name), "text")]
    return Language([r[0] for r in _bounded(table(spark, sf_dir, "common_words"), "word")], samples)


def text_quality(df: DataFrame, id_col: str, text_col: str, language: Language) -> DataFrame:
    """id and the columns of STATISTICS of every row with an id.

    Ratios are of the characters that aren't blanks, or of the words or lines; where there are none they are 0. Null, empty and blank texts
    have zeros and the kind `blank`. kind is `prose`, `list`, `table` or `junk`; what a text mainly is, by characters, decides, and a
    sentence of introduction doesn't count. Repeated rows are described again; other columns, whatever their names, are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast(language)

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts, rows = texts_of(batch, "c0"), []
            for lo, hi in blocks(texts):
                rows += describe(texts[lo:hi], sent.value)
            return {"id": batch.column("id")} | {c: [r[c] for r in rows] for c in STATISTICS}

        return f

    docs = keyed(df, id_col, text_col)
    return arrow_map(docs, make, f"id {docs.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in STATISTICS.items()))


def p1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the kind of every record."""
    return text_quality(table(spark, sf_dir, "culturax_it_ppl95"), "rec_id", "text", known_language(spark, sf_dir)).withColumnRenamed("id", "rec_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id and kind (list, table or junk) of each record that is mainly no prose."""
    return p1_stats(spark, sf_dir).where(F.col("kind").isin("list", "table", "junk")).select("rec_id", "kind")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and mean statistics by kind."""
    means = [F.round(F.avg(c), 4).alias(c) for c in ("common_words", "known_trigrams", "duplicate_lines", "top_4gram", "punctuated_lines")]
    return p1_stats(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("n_records"), *means)


def p1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that aren't blanks, and words, of every record."""
    return p1_stats(spark, sf_dir).select("rec_id", "n_chars", "n_words")

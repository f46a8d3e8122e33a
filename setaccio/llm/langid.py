"""Problem 3: the languages of each text and of each segment of a mixed one.

Letter n-grams of sample texts are kept in a bit-sliced Bloom filter: each of its cells is a byte with a bit a language, and the
AND of an n-gram's cells is the mask of all languages that have it, found in one look-up. The masks of a word's n-grams
are summed in packed lanes, a count a language; counts over a window of words, corrected for false positives, give
each word's language, and runs of one language give the segments.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, keyed, table, texts_of
from .quality import Language, _bounded, describe, known_language
from .wordhash import blocks, mix

#: Lengths of the n-grams; a word's ends count as a letter each.
SIZES = (3, 4, 5)
#: Cells of the filter as a power of two, and cells of an n-gram.
CELLS_LOG2, CELLS = 18, 3
#: Words to either side that decide a word's language with it.
AROUND = 3
#: What the share over a whole sentence weighs beside that over the window.
SENTENCE_WEIGHT = 0.5
#: Words a segment has at least; shorter runs join the longer one beside them.
LEAST_WORDS = 4
#: Words with which a segment counts as a whole sentence although no stop is at both its ends.
WHOLE_WORDS = 8
#: Corrected share of its n-grams that a segment's language must have, and its lead over any other, for the language to count.
LEAST_SHARE, LEAD = 0.75, 0.15
#: N-grams of one word depend on each other; this many count as one observation.
DEPENDENT = 6
#: Letters a word may have for its counts to fit their lanes; longer ones, which no language has, count as none.
LONGEST_WORD = 300
#: Lanes of 10 bits in 64.
MOST_LANGUAGES = 6

#: Codes and names under which labels give the six languages.
NAMES = {
    "de": ("de", "deu", "ger", "german", "deutsch", "tedesco"),
    "en": ("en", "eng", "english", "inglese"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano", "spagnolo"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francese"),
    "it": ("it", "ita", "italian", "italiano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues", "portoghese"),
}

#: Languages that write common nouns with a capital; in the others a capital inside a sentence begins a name.
CAPITALISED_NOUNS = {"de"}
_NAME = re.compile(r"(?<=[^\W\d_][ \n])[^\W\d_a-z]\w+|(?<=[,;] )[^\W\d_a-z]\w+")

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-case form of each letter, 0 of what is no letter, 1 of a combining mark (to be dropped)."""
    if not _tables:
        t = np.zeros(0x110000, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
            elif unicodedata.combining(c):
                t[i] = 1
        _tables.append(t)
    return _tables[0]


def _stops() -> np.ndarray:
    """Whether a character ends a sentence or begins another."""
    if len(_tables) < 2:
        _letters()
        t = np.zeros(0x110000, dtype=bool)
        t[[ord(c) for c in ".!?;:…«»“”\0"]] = True
        _tables.append(t)
    return _tables[1]


class Words:
    """The words of a block of texts: where they and their sentences begin, and their n-grams."""

    def __init__(self, texts: list[str]):
        cp = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        starts = np.cumsum([1] + [len(t) + 1 for t in texts])
        low = _letters()[cp]
        self.place = np.flatnonzero(low != 1)
        low = low[self.place]
        inside = low > 0
        first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        last = np.flatnonzero(inside[:-1] & ~inside[1:])
        self.size = last - first + 1
        self.begin, self.end = self.place[first], self.place[last] + 1
        self.offsets = np.searchsorted(self.begin, starts)
        self.begin, self.end = self.begin - np.repeat(starts[:-1], np.diff(self.offsets)), self.end - np.repeat(starts[:-1], np.diff(self.offsets))
        self.first, self.low = first, low
        stops = np.concatenate(([0], np.cumsum(_stops()[cp])))[self.place[first]]
        new = np.concatenate(([True], stops[1:] != stops[:-1])) if len(first) else np.zeros(0, bool)
        new[self.offsets[:-1][self.offsets[:-1] < len(first)]] = True
        self.sentence = np.flatnonzero(new)  # first word of each sentence

    def grams(self):
        """(word of each n-gram, its hash) for each length; the hash of a longer one goes on from that of the shorter at its place."""
        count = np.where(self.size <= LONGEST_WORD, np.maximum(self.size + 3 - SIZES[0], 0), 0)
        word = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        at, base = self.first[word] - 1 + inside, np.uint64(0x9E3779B97F4A7C15)
        room = self.size[word] + 2 - inside  # letters and ends from here on
        h = np.zeros(len(word), dtype=np.uint64)
        for k in range(SIZES[0] - 1):
            h = h * base + self.low[at + k]
        for n in SIZES:
            if n > SIZES[0]:
                keep = np.flatnonzero(room >= n)
                word, at, room, h = word[keep], at[keep], room[keep], h[keep]
            if not len(word):
                return
            h = h * base + self.low[at + n - 1]
            yield word, mix(h + np.uint64(n))


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - CELLS_LOG2 * (k + 1))) & np.uint64((1 << CELLS_LOG2) - 1) for k in range(CELLS)]


class Languages:
    """The filter of some languages' n-grams, trained on sample texts and words."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.names = sorted({lang for lang, _ in samples})
        if not 0 < len(self.names) <= MOST_LANGUAGES:
            raise ValueError(f"1 to {MOST_LANGUAGES} languages are needed, not {len(self.names)}")
        self.cells = np.zeros(1 << CELLS_LOG2, dtype=np.uint8)
        for k, name in enumerate(self.names):
            self._add([t for lang, t in samples if lang == name], 1 << k)
        # names are of no language: their n-grams go to all of them
        self._add([w for lang, t in samples if lang not in CAPITALISED_NOUNS for w in _NAME.findall(t)], (1 << len(self.names)) - 1)
        self.false = np.array([((self.cells >> k) & 1).mean() ** CELLS for k in range(len(self.names))])
        self.lanes = np.array([sum(1 << (10 * k) for k in range(MOST_LANGUAGES) if m >> k & 1) for m in range(256)], dtype=np.uint64)

    def _add(self, texts: list[str], mask: int) -> None:
        for _, h in Words(texts).grams():
            for c in _cells(h):
                np.bitwise_or.at(self.cells, c, np.uint8(mask))

    def counts(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each word that each language has; n-grams of each word)."""
        packed, total = np.zeros(len(words.size), dtype=np.uint64), np.zeros(len(words.size), dtype=np.int64)
        for word, h in words.grams():
            a, b, c = _cells(h)
            hit = self.lanes[self.cells[a] & self.cells[b] & self.cells[c]]
            edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            packed[word[edge]] += np.add.reduceat(hit, edge)
            total[word[edge]] += np.diff(np.append(edge, len(word)))
        return np.stack([(packed >> np.uint64(10 * k)) & np.uint64(1023) for k in range(len(self.names))], axis=1).astype(np.int64), total

    def corrected(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Shares of n-grams that each language really has."""
        share = hits / np.maximum(total, 1)[..., None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1)

    def posterior(self, hits: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Probability of each language, where a text's own language has 97 of 100 n-grams."""
        log = (hits * np.log(0.97 / 0.03) + total[..., None] * np.log(0.03)) / DEPENDENT
        p = np.exp(log - log.max(axis=-1, keepdims=True))
        return p / p.sum(axis=-1, keepdims=True)


def _runs(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
    return edge, np.diff(np.append(edge, len(label)))


def _joined(label: np.ndarray) -> np.ndarray:
    """Labels of one text after its short runs, the shortest first, have joined the longer run beside them."""
    if len(label) <= LEAST_WORDS:
        return label
    edge, lengths = _runs(label)
    value, size, n = label[edge].tolist(), lengths.tolist(), len(edge)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    short = [(s, k) for k, s in enumerate(size) if s < LEAST_WORDS]
    heapq.heapify(short)

    def join(k: int, r: int) -> None:
        size[k], size[r], after[k] = size[k] + size[r], 0, after[r]
        if after[k] < n:
            before[after[k]] = k

    while short:
        s, k = heapq.heappop(short)
        if size[k] != s:
            continue  # it has joined another or grown since
        left, right = before[k], after[k]
        if left < 0 and right >= n:
            break
        value[k] = value[left] if left >= 0 and (right >= n or size[left] >= size[right]) else value[right]
        if right < n and value[right] == value[k]:
            join(k, right)
        if left >= 0 and value[left] == value[k]:
            join(left, k)
            k = left
        if size[k] < LEAST_WORDS:
            heapq.heappush(short, (size[k], k))
    return np.repeat(value, size)


def segments(texts: list[str], languages: Languages) -> list[list[tuple]]:
    """For each text: (language, begin, end, words, share, lead, confidence, whether it begins and ends as sentences do) of each
    of its segments, in order."""
    words = Words(texts)
    hits, total = languages.counts(words)
    cum, ctotal = np.concatenate((np.zeros((1, hits.shape[1]), np.int64), np.cumsum(hits, axis=0))), np.concatenate(([0], np.cumsum(total)))
    n = len(total)
    edges = np.append(words.sentence, n)
    inside = np.repeat(edges[:-1], np.diff(edges)), np.repeat(edges[1:], np.diff(edges))
    lo, hi = np.maximum(np.arange(n) - AROUND, inside[0]), np.minimum(np.arange(n) + AROUND + 1, inside[1])
    share = lambda a, b: (cum[b] - cum[a]) / np.maximum(ctotal[b] - ctotal[a], 1)[:, None]
    whole = np.repeat(share(edges[:-1], edges[1:]), np.diff(edges), axis=0)
    label = (share(lo, hi) + SENTENCE_WEIGHT * whole).argmax(axis=1) if n else np.zeros(0, np.int64)
    starts = np.zeros(n + 1, dtype=bool)
    starts[edges] = True
    out = []
    for k in range(len(texts)):
        a, b = int(words.offsets[k]), int(words.offsets[k + 1])
        if a == b:
            out.append([])
            continue
        own = label[a:b]
        edge, size = _runs(own if (own == own[0]).all() else _joined(own))
        edge = edge + a
        h, t = cum[edge + size] - cum[edge], ctotal[edge + size] - ctotal[edge]
        share, sure = languages.corrected(h, t), languages.posterior(h, t)
        best = h.argmax(axis=1)
        rows = []
        for i, (e, s, l) in enumerate(zip(edge.tolist(), size.tolist(), best.tolist())):
            others = np.delete(share[i], l)
            whole = bool(starts[e] and starts[e + s])
            rows.append((languages.names[l], int(words.begin[e]), int(words.end[e + s - 1]), s, float(share[i, l]), float(share[i, l] - (others.max() if len(others) else 0)), float(sure[i, l]), whole))
        out.append(rows)
    return out


def languages_of(rows: list[tuple]) -> list[str]:
    """The languages of which a text has a whole segment; of a text in which none is clear, the clearest one."""
    clear = {r[0] for r in rows if r[3] >= (LEAST_WORDS if r[7] else WHOLE_WORDS) and r[4] >= LEAST_SHARE and r[5] >= LEAD}
    if not clear and rows:
        clear = {max(rows, key=lambda r: (r[3] * r[4], r[0]))[0]}
    return sorted(clear)


def label_language(label):
    """A column's label as a two-letter code: null if it is missing or names none of the languages known here."""
    code = F.lower(F.trim(label))
    short = F.when(code.rlike(r"^[a-z]{2,3}([-_][a-z0-9]{2,8})*$"), F.regexp_extract(code, r"^([a-z]{2,3})", 1)).otherwise(code)
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(short.isin(*names), F.lit(lang)).otherwise(out)
    return out


def _samples(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    found = [tuple(r) for r in _bounded(table(spark, sf_dir, "lang_samples"), "lang", "text")]
    found += [("it", r[0]) for r in _bounded(table(spark, sf_dir, "reading_samples"), "text")]
    return found + [tuple(r) for r in _bounded(table(spark, sf_dir, "common_words"), "lang", "word")]


SEGMENT = "array<struct<lang:string,begin:int,end:int,n_words:int,share:double,lead:double,confidence:double,whole:boolean>>"


def identify(df: DataFrame, id_col: str, text_col: str, languages: Languages, language: Language, label_col: str | None = None) -> DataFrame:
    """id, label (as it is in label_col, null without one), kind, langs and segments of every row with an id.

    kind is that of problem 1. langs are the languages of which the text has a whole segment, in alphabetical order; a segment's
    begin and end are characters of the text. Null, empty and blank texts, and texts without a letter, have no segments and no
    languages. A text of a few words has the likeliest language, with its confidence. Repeated rows are given again.
    """
    sent = df.sparkSession.sparkContext.broadcast((languages, language))
    docs = keyed(df, id_col, text_col, label_col) if label_col else keyed(df, id_col, text_col).withColumn("c1", F.lit(None).cast("string"))

    def make():
        known, common = sent.value
        names = [x.split(":")[0] for x in SEGMENT.split("<")[-1].rstrip(">").split(",")]

        def f(batch: pa.RecordBatch) -> dict:
            texts, kinds, rows = texts_of(batch, "c0"), [], []
            for lo, hi in blocks(texts):
                kinds += [s["kind"] for s in describe(texts[lo:hi], common)]
                rows += segments(texts[lo:hi], known)
            return {
                "id": batch.column("id"), "label": batch.column("c1"), "kind": kinds, "langs": [languages_of(r) for r in rows],
                "segments": [[dict(zip(names, s)) for s in r] for r in rows],
            }

        return f

    return arrow_map(docs, make, f"id {docs.schema['id'].dataType.simpleString()}, label string, kind string, langs array<string>, segments {SEGMENT}")


def _culturax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "culturax_it_ppl95"), "rec_id", "text", Languages(_samples(spark, sf_dir)), known_language(spark, sf_dir), "lang")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id and lang of each record whose label is missing or wrong or whose text has several languages, one row a language."""
    found = _culturax(spark, sf_dir).withColumnRenamed("id", "rec_id").where("kind in ('prose', 'list') and size(langs) > 0")
    label = label_language(F.col("label"))
    case = (F.size("langs") > 1) | label.isNull() | (label != F.get("langs", F.lit(0)))
    return found.where(case).select("rec_id", F.explode("langs").alias("lang")).distinct()


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, kind, label (as a code), langs, confidence of the clearest segment, and whether the label is missing or wrong, or the text mixed."""
    found, several = _culturax(spark, sf_dir).withColumn("label", label_language(F.col("label"))), F.size("langs") > 1
    return found.select(
        F.col("id").alias("rec_id"), "kind", "label", F.array_join("langs", " ").alias("langs"), F.round(F.array_max(F.col("segments.confidence")), 6).alias("confidence"),
        F.col("label").isNull().alias("missing"), several.alias("mixed"), (~several & (F.col("label") != F.get("langs", F.lit(0)))).alias("wrong"),
    )


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment of each record: its place in the text, its words, its language and the confidence."""
    s = _culturax(spark, sf_dir).select(F.col("id").alias("rec_id"), F.posexplode("segments").alias("segment", "s"))
    return s.select("rec_id", "segment", "s.lang", "s.begin", "s.end", "s.n_words", F.round("s.share", 6).alias("share"), F.round("s.confidence", 6).alias("confidence"))

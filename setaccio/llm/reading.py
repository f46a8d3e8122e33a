"""Problem 8: reading level by gradient-boosted regression trees.

Features are means over windows of consecutive words: length, vocabulary (how much likelier words and their letter trigrams are in one level's
samples), syntax (subordination, commas, stops) and cohesion (words met again). The trees are trained on windows of the
graded samples and of variants of them without stops, in capitals and with sentences joined; a sample's own
words are left out of the vocabulary its windows are measured by. A text's level is the median of its windows'
grades, cut at thresholds calibrated by cross-validation, so that a sentence of another level doesn't move it.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import arrow_map, table
from .gbt import Boosted
from .leakage import plain
from .quality import MOST_SAMPLES, Language, _bounded, _trigrams, describe, known_language
from .wordhash import _mark_table, _word_table, blocks, fold, word_hashes

#: Words of a window, and of the step from one to the next.
WINDOW, STEP = 32, 16
#: Words of a text from which a level is given.
LEAST_WORDS = 60
#: Characters of samples that the model may be trained on.
MOST_CHARS = 4_000_000
#: Parts of the cross-validation.
FOLDS = 6
#: Words within which a word counts as met again.
NEAR = 40
LEVELS = (1, 2, 3)

#: Subordinating conjunctions and relative pronouns of Italian, a closed class.
SUBORDINATORS = (
    "che", "cui", "quale", "quali", "chi", "se", "perche", "poiche", "giacche", "siccome", "benche", "sebbene", "quantunque", "nonostante", "malgrado", "affinche", "acciocche", "purche", "qualora", "ove", "laddove",
    "quando", "mentre", "finche", "appena", "dopoche", "prima", "come", "dove", "donde", "quanto", "cosicche", "sicche", "dacche", "fuorche", "eccetto", "ancorche", "allorche",
)

FEATURES = ("length", "long", "spread", "word_1", "word_2", "word_3", "known", "gram_1", "gram_3", "common", "subordinate", "comma", "stop", "again")


def _hash_set(words: tuple[str, ...]) -> np.ndarray:
    return np.unique(word_hashes([fold(w) for w in words])[0])


def _among(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return known[at] == words


class Vocabulary:
    """Log odds of words and of letter trigrams for each level against the others."""

    def __init__(self, texts: list[str], levels: np.ndarray):
        words, offsets = word_hashes(texts)
        level = np.repeat(levels, np.diff(offsets))
        self.words, code = np.unique(words, return_inverse=True)
        counts = np.stack([np.bincount(code[level == k], minlength=len(self.words)) for k in LEVELS]).astype(float)
        self.odds = self._odds(counts, 0.5)
        codes, at, inner = _trigrams(texts)
        level = np.repeat(levels, np.diff(at))
        keep = inner[: len(level)]
        grams = np.stack([np.bincount(codes[: len(level)][keep & (level == k)], minlength=1 << 15) for k in LEVELS]).astype(float)
        self.grams = self._odds(grams, 2.0)

    @staticmethod
    def _odds(counts: np.ndarray, add: float) -> np.ndarray:
        p = np.log((counts + add) / (counts.sum(axis=1, keepdims=True) + add * counts.shape[1]))
        return np.stack([p[k] - (p.sum(axis=0) - p[k]) / 2 for k in range(3)]).clip(-4, 4)


_SETS: dict[str, np.ndarray] = {}


def _sets() -> dict[str, np.ndarray]:
    if not _SETS:
        _SETS.update(subordinate=_hash_set(SUBORDINATORS))
    return _SETS


def _stops_after(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a comma (or colon, semicolon) and whether a full stop follows each of the n words directly."""
    joined = "\0".join(texts)
    cp = np.frombuffer((joined + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cp = cp[~_mark_table()[cp]]
    inside = _word_table()[cp]
    after = cp[np.flatnonzero(inside[:-1] & ~inside[1:]) + 1]
    assert len(after) == n
    return np.isin(after, [ord(c) for c in ",;:"]), np.isin(after, [ord(c) for c in ".!?"])


def windows(texts: list[str], vocabulary: Vocabulary, language: Language, found: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each window, offsets by text) of plain texts; a text without words has no window. found: their words, if they are known."""
    words, offsets, sizes, _ = found or word_hashes(texts, details=True)
    n = len(words)
    if not n:
        return np.zeros((0, len(FEATURES))), np.zeros(len(texts) + 1, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary.words, words), len(vocabulary.words) - 1)
    known = vocabulary.words[at] == words
    odds = np.where(known, vocabulary.odds[:, at], 0.0)
    codes, code_at, inner = _trigrams(texts)
    letter = codes >> 5 & 31
    first = np.flatnonzero(((letter > 0) & np.concatenate(([True], letter[:-1] == 0))))
    grams = np.add.reduceat(np.where(inner, vocabulary.grams[:, codes], 0.0), first, axis=1) / sizes if len(first) == n else np.zeros((3, n))
    comma, stop = _stops_after(texts, n)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    key = words ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = np.zeros(n, dtype=bool)
    again[order[1:][(key[order[1:]] == key[order[:-1]]) & (np.diff(order) <= NEAR)]] = True
    common = language.is_common(words)
    width = np.minimum(sizes, 30).astype(float)
    columns = (width, sizes >= 9, width**2, *odds, known, grams[0], grams[2], common, _among(words, _sets()["subordinate"]), comma, stop, again & ~common)
    cum = np.concatenate((np.zeros((1, len(columns))), np.cumsum(np.stack(columns, axis=1).astype(float), axis=0)))
    counts = np.where(np.diff(offsets) > 0, 1 + np.maximum(np.diff(offsets) - WINDOW + STEP - 1, 0) // STEP, 0)
    out = np.concatenate(([0], np.cumsum(counts)))
    k = np.arange(out[-1]) - np.repeat(out[:-1], counts)
    end = np.minimum(np.repeat(offsets[:-1], counts) + k * STEP + WINDOW, np.repeat(offsets[1:], counts))
    begin = np.maximum(end - WINDOW, np.repeat(offsets[:-1], counts))
    x = (cum[end] - cum[begin]) / (end - begin)[:, None]
    x[:, 2] = np.sqrt(np.maximum(x[:, 2] - x[:, 0] ** 2, 0))
    return x, out


_STOP = re.compile(r"[.!?…]+")
_BREAK = re.compile(r"[.!?…]+\s+(\w)")


def _variants(text: str) -> list[str]:
    """A sample as it is, without sentence ends, with its sentences joined, and without any punctuation."""
    return [text, _STOP.sub("", text), _BREAK.sub(lambda m: " e poi " + m[1], text), re.sub(r"[^\w\s']", " ", text)]


def parts_of(levels: np.ndarray) -> np.ndarray:
    """The part of the cross-validation of each sample; each part has its share of each level."""
    out = np.empty(len(levels), dtype=np.int64)
    for k in LEVELS:
        own = np.flatnonzero(levels == k)
        out[own] = np.random.default_rng(k).permutation(len(own)) % FOLDS
    return out


class Grader:
    """Trees and thresholds trained on graded samples."""

    def __init__(self, samples: list[tuple[str, int]], language: Language):
        samples = [(plain(t), k) for t, k in samples if k in LEVELS and t.strip()]
        if len({k for _, k in samples}) < len(LEVELS):
            raise ValueError("samples of every level are needed")
        self.language = language
        texts, y = [t for t, _ in samples], np.array([k for _, k in samples])
        fold_of = parts_of(y)
        parts = []
        for part in range(FOLDS):
            inside = np.flatnonzero(fold_of == part)
            vocabulary = Vocabulary([texts[i] for i in np.flatnonzero(fold_of != part)], y[fold_of != part])
            variants = [v for i in inside for v in _variants(texts[i])]
            x, at = windows(variants, vocabulary, language)
            of = np.repeat(np.repeat(inside, len(variants) // max(1, len(inside))), np.diff(at))
            parts.append((x, of))
        x, of = (np.concatenate(c) for c in zip(*parts))
        # the cross-validated median grade of each sample, by which the thresholds are set
        self.grades = np.zeros(len(y))
        for part in range(FOLDS):
            model = Boosted().fit(x[fold_of[of] != part], y[of][fold_of[of] != part].astype(float))
            for i in np.flatnonzero(fold_of == part):
                self.grades[i] = np.median(model.predict(x[of == i]))
        self.levels = y
        self.thresholds = tuple(self._threshold(k) for k in LEVELS[:-1])
        self.model = Boosted().fit(x, y[of].astype(float))
        self.vocabulary = Vocabulary(texts, y)

    def _threshold(self, level: int) -> float:
        """Between the grades of a level and of the next: the cut of fewest errors, in the middle of the widest such gap."""
        grades = np.sort(self.grades)
        cuts = np.concatenate(([grades[0] - 1], (grades[1:] + grades[:-1]) / 2, [grades[-1] + 1]))
        errors = [((self.grades > c) != (self.levels > level)).sum() for c in cuts]
        widths = np.concatenate(([0], np.diff(grades), [0]))
        return float(max(zip(cuts, errors, widths), key=lambda c: (-c[1], c[2]))[0])

    def level(self, grade) -> np.ndarray:
        return 1 + sum((np.asarray(grade) > t).astype(np.int64) for t in self.thresholds)

    def grade(self, texts: list[str], found: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """The median grade of each plain text's windows; not a number for a text without words."""
        out = np.full(len(texts), np.nan)
        x, at = windows(texts, self.vocabulary, self.language, found)
        if len(x):
            y = self.model.predict(x)
            for k in np.flatnonzero(np.diff(at)):
                out[k] = np.median(y[at[k] : at[k + 1]])
        return out


class Italian:
    """Whether a text's common words are mainly Italian ones."""

    def __init__(self, common: list[tuple[str, str]]):
        self.hashes = {lang: _hash_set(tuple(w for k, w in common if k == lang)) for lang in sorted({k for k, _ in common})}
        self.every = np.unique(np.concatenate(list(self.hashes.values())))

    def mainly(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text by its words' hashes."""
        common = np.flatnonzero(_among(words, self.every))  # a third of the words, looked up by language
        doc = np.searchsorted(offsets, common, side="right") - 1
        counts = {lang: np.bincount(doc[_among(words[common], h)], minlength=len(offsets) - 1) for lang, h in self.hashes.items()}
        most = np.max(list(counts.values()), axis=0)
        return (counts.get("it", np.zeros(len(offsets) - 1)) == most) & (most >= 0.08 * np.diff(offsets))


def _graded(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    samples = [tuple(r) for r in _bounded(table(spark, sf_dir, "reading_samples"), "text", "reading_level")]
    if sum(len(t) for t, _ in samples) > MOST_CHARS:
        raise ValueError(f"samples of more than {MOST_CHARS} characters, {MOST_SAMPLES} rows at most")
    return samples


def _models(spark: SparkSession, sf_dir: str) -> tuple[Grader, Italian]:
    common = [tuple(r) for r in _bounded(table(spark, sf_dir, "common_words"), "lang", "word")]
    return Grader(_graded(spark, sf_dir), known_language(spark, sf_dir)), Italian(common)


def held_out(spark: SparkSession, samples: list[tuple[str, int]], language: Language) -> list[tuple[Grader, list[tuple[str, int]]]]:
    """For each part of the samples a grader trained wholly without it (vocabulary, trees and thresholds), and the part; a task fits each."""
    samples = [(t, k) for t, k in samples if k in LEVELS and t.strip()]
    part_of = parts_of(np.array([k for _, k in samples]))
    sent = spark.sparkContext.broadcast((samples, part_of, language))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, known = sent.value
        for batch in batches:
            for part in batch.column("id").to_pylist():
                grader = Grader([s for s, p in zip(own, parts) if p != part], known)
                yield pa.RecordBatch.from_pydict({"part": [part], "grader": [pickle.dumps(grader)]})

    # FOLDS rows of a vocabulary of the samples' words, whose number is bounded
    rows = sorted(spark.range(0, FOLDS, 1, FOLDS).mapInArrow(fit, "part long, grader binary").collect())
    return [(pickle.loads(r.grader), [s for s, p in zip(samples, part_of) if p == r.part]) for r in rows]


def reading_levels(df: DataFrame, id_col: str, text_col: str, grader: Grader, italian: Italian, source_col: str | None = None, others: list[Grader] | None = None) -> DataFrame:
    """id, source (null without source_col), n_words, grade and reading_level of each row of running Italian prose of `LEAST_WORDS` words or more.

    others: graders of which each row gets the grade and level by one (other_grade, other_level), told by its id's hash; null without them.

    Null, empty and blank texts, shorter ones, lists, tables and junk, and texts in another language have no row; nor have rows without an id.
    Repeated rows are given again. Texts are read whole. Other columns, whatever their names, are not read.
    """
    sent = df.sparkSession.sparkContext.broadcast((grader, italian, others or []))
    source = df[source_col] if source_col else F.lit(None).cast("string")
    docs = df.select(df[id_col].alias("id"), df[text_col].alias("text"), source.alias("source")).where("id is not null and text is not null")
    docs = docs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, len(others or [])))).cast("int"))

    def make():
        model, it, more = sent.value

        def f(batch: pa.RecordBatch) -> dict:
            texts = batch.column("text").to_pylist()
            counts = [len(t.split()) for t in texts]
            part = np.array(batch.column("part").to_pylist())
            rows, grades, second = [], [], {}
            for lo, hi in blocks(texts):
                own = [i for i in range(lo, hi) if counts[i] >= LEAST_WORDS]
                if not own:
                    continue
                clean = [plain(texts[i]) for i in own]
                found = word_hashes(clean, details=True)
                keep = np.flatnonzero(it.mainly(*found[:2]))
                kinds = describe([texts[own[k]] for k in keep], model.language)
                keep = [k for k, s in zip(keep, kinds) if s["kind"] == "prose"]
                rows += [own[k] for k in keep]
                grades.append(model.grade(clean, found)[keep])
                for p in set(part[[own[k] for k in keep]].tolist()) if more else ():
                    mine = [k for k in keep if part[own[k]] == p]
                    got = more[p].grade([clean[k] for k in mine])
                    second.update((own[k], (float(g), int(v))) for k, g, v in zip(mine, got, more[p].level(got)))
            grade, at = np.concatenate(grades) if grades else np.zeros(0), pa.array(rows, type=pa.int64())
            return {
                "id": batch.column("id").take(at), "source": batch.column("source").take(at), "n_words": [counts[i] for i in rows],
                "grade": pa.array(grade), "reading_level": pa.array(model.level(grade).astype(np.int32)),
                "other_grade": [second.get(i, (None, None))[0] for i in rows], "other_level": [second.get(i, (None, None))[1] for i in rows],
            }

        return f

    return arrow_map(docs, make, f"id {docs.schema['id'].dataType.simpleString()}, source string, n_words int, grade double, reading_level int, other_grade double, other_level int")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", *_models(spark, sf_dir), "source")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and reading_level of each document of running Italian prose."""
    return _documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "reading_level")


def p8_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, words and mean grade by source and level."""
    found = _documents(spark, sf_dir).groupBy("source", "reading_level")
    return found.agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"), F.round(F.avg("grade"), 4).alias("mean_grade"))


def p8_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part of the samples and each level: samples, those graded right by a grader that hasn't seen the part in any step, and the mean error of their grades."""
    rows = []
    for part, (grader, own) in enumerate(held_out(spark, _graded(spark, sf_dir), known_language(spark, sf_dir))):
        grades, levels = grader.grade([plain(t) for t, _ in own]), np.array([k for _, k in own])
        for k in LEVELS:
            mine = levels == k
            rows.append((part, k, int(mine.sum()), int((grader.level(grades[mine]) == k).sum()), round(float(np.abs(grades[mine] - k).mean()), 6) if mine.any() else None))
    return spark.createDataFrame(rows, "part int, reading_level int, n_samples int, n_right int, mean_error double")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source of documents: how many are graded, the share that a grader trained without a part of the samples gives the same level, and the mean
    difference of the two grades. Each document meets one of those graders, so all of them judge every source."""
    others = [g for g, _ in held_out(spark, _graded(spark, sf_dir), known_language(spark, sf_dir))]
    found = reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", *_models(spark, sf_dir), "source", others).groupBy("source")
    same = F.avg((F.col("reading_level") == F.col("other_level")).cast("double"))
    return found.agg(F.count(F.lit(1)).alias("n_documents"), F.round(same, 6).alias("same_level"), F.round(F.avg(F.abs(F.col("grade") - F.col("other_grade"))), 6).alias("mean_difference"))

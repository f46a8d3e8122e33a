"""Quality rules as features, predicates and reject reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from setaccio.functions import text as T

#: Limits of the composite rule.
MIN_WORDS, MOST_SYMBOLS, LEAST_DISTINCT_LINES, LEAST_LETTERS, MOST_MIXED = 50, 0.35, 0.5, 0.30, 0.05
#: Lines up to which repeated ones don't matter.
FEW_LINES = 5
_NO_LETTERS, _KNOWN = r"[^\p{L}]+", rf"[\p{{L}}\p{{Nd}}{T.BLANKS}]+"
_MIXED = r"[a-zA-Z]\d|\d[a-zA-Z]"


def features(c: Column) -> dict[str, Column]:
    """What the rules look at; ratios of an empty text are null."""
    words, lines, n = T.words(c), T.lines(c), F.length(c)
    return {
        "n_words": F.size(words), "n_chars": n,
        "symbol_ratio": F.try_divide(F.length(F.regexp_replace(c, _KNOWN, "")), n),
        "n_lines": F.size(lines), "distinct_lines": F.size(F.array_distinct(lines)),
        "alpha_ratio": F.try_divide(F.length(F.regexp_replace(c, _NO_LETTERS, "")), n),
        "mixed_ratio": F.try_divide(F.when(c.rlike(_MIXED), F.size(F.filter(words, lambda w: w.rlike(_MIXED)))).otherwise(0), F.size(words)),
    }


def with_features(df: DataFrame, text_col: str) -> DataFrame:
    """df and the features of a text column in a struct `f`, so that each is worked out once."""
    return df.withColumn("f", F.struct(*(v.alias(k) for k, v in features(F.col(text_col)).items())))


def rules(min_words: int = MIN_WORDS, f: str = "f") -> dict[str, Column]:
    """The predicates over a struct of features in the order they are tried; each says what is kept."""
    x = F.col(f)
    return {
        "min_words": x.n_words >= min_words,
        "empty": x.n_chars > 0,
        "symbols": x.symbol_ratio <= MOST_SYMBOLS,
        "repeated_lines": (x.n_lines <= FEW_LINES) | (x.distinct_lines / F.greatest(x.n_lines, F.lit(1)) >= LEAST_DISTINCT_LINES),
        "letters": x.alpha_ratio >= LEAST_LETTERS,
        "mixed": x.mixed_ratio <= MOST_MIXED,
    }


def reject_reason(min_words: int = MIN_WORDS) -> Column:
    """The first rule a text breaks; null if it keeps all. A rule on nothing (an empty text) is broken."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(rules(min_words).items()):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def heuristic(df: DataFrame, text_col: str, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows whose text keeps every rule; null texts are dropped."""
    kept = with_features(df.where(F.col(text_col).isNotNull()), text_col)
    for ok in rules(min_words).values():
        kept = kept.where(ok)
    return kept.drop("f")


def min_chars(df: DataFrame, text_col: str, n: int) -> DataFrame:
    return df.where(F.length(text_col) >= n)


def metadata_language(df: DataFrame, lang_col: str, lang: str) -> DataFrame:
    """Rows whose label is exactly the language; a plain predicate, so it is pushed into the scan."""
    return df.where(F.col(lang_col) == lang)


def perplexity_cut(df: DataFrame, ppl_col: str, cut: float | None) -> DataFrame:
    """Rows of perplexity at most cut; equal ones stay, infinite, undefined and null ones go. No cut keeps all that are finite."""
    limit = F.lit(float("inf")) if cut is None else F.lit(float(cut))
    return df.where((F.col(ppl_col) <= limit) & (F.col(ppl_col) < float("inf")) & ~F.isnan(ppl_col))

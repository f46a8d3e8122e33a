"""The curation pipeline: rules, language, paragraph dedup, perplexity cut, and what each stage dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from setaccio.operators import dedup, filters, scoring
from setaccio.plans.tables import cut


def perplexity_limit(passing: DataFrame, id_col: str, ppl_col: str, share: float, sample: int = 5000) -> float | None:
    """The perplexity at a share of the first `sample` documents, in order, that have a finite one; null without any.

    The documents given are those that keep the rules, whatever their language.
    """
    finite = F.col(ppl_col).isNotNull() & ~F.isnan(ppl_col) & (F.col(ppl_col) < float("inf"))
    head = cut(scoring.first_sample(passing.where(finite).select(id_col, ppl_col), id_col, sample))
    row = scoring.index_percentiles(head, ppl_col, [share]).first()
    return None if row is None else row["value"]


def curate(df: DataFrame, id_col: str, text_col: str, lang: tuple[str, str] | None = None, separator: str = "\n\n", ppl: tuple[str, float] | None = None, min_words: int = filters.MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(curated id_col, text_col; one row of how many went in, were dropped by each stage, and came out).

    Stages run in the order of their cost: the rules, the language label (column, value), first paragraphs, perplexity (column, share).
    Paragraphs of documents that the perplexity drops later still count as met. Null texts don't go in.
    """
    texts = df.where(F.col(text_col).isNotNull())
    marked = filters.with_features(texts, text_col).withColumn("reason", filters.reject_reason(min_words)).drop("f")
    if lang:
        wrong = F.coalesce(F.col(lang[0]) != lang[1], F.lit(True))
        marked = marked.withColumn("reason", F.when(F.col("reason").isNotNull(), "heuristic").when(wrong, "lang"))
    else:
        marked = marked.withColumn("reason", F.when(F.col("reason").isNotNull(), "heuristic"))
    keep = [id_col, text_col, "reason", *([ppl[0]] if ppl else [])]
    marked = cut(marked.select(*keep))
    limit = perplexity_limit(marked.where("reason is null or reason != 'heuristic'"), id_col, *ppl) if ppl else None
    clean = marked.where("reason is null")
    unique = cut(dedup.paragraph_dedup(clean, id_col, text_col, separator))
    out = unique
    if ppl:
        scores = clean.select(id_col, ppl[0])
        out = cut(filters.perplexity_cut(unique.join(scores, id_col), ppl[0], limit).select(id_col, text_col))  # for the result and its count
    before = marked.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(F.col("reason") == "heuristic").alias("heuristic"), F.count_if(F.col("reason") == "lang").alias("lang"), F.count_if(F.col("reason").isNull()).alias("clean"))
    counts = before.withColumns({"unique": unique.agg(F.count(F.lit(1))).scalar(), "n_out": out.agg(F.count(F.lit(1))).scalar()})
    funnel = counts.select("n_in", "heuristic", "lang", (F.col("clean") - F.col("unique")).alias("dedup"), (F.col("unique") - F.col("n_out")).alias("ppl"), "n_out")
    return out, funnel

"""Perplexity of evaluation runs: per corpus and checkpoint, comparisons, best so far, forgetting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from setaccio.operators.budget import range_of

#: Ratio over the baseline from which a model counts as forgetting.
FORGETTING = 1.15


def chunks(df: DataFrame) -> DataFrame:
    """The chunks of evaluation runs, each once: identical rows are merged, and those without a loss or tokens left out."""
    return df.where("loss is not null and n_tokens > 0").dropDuplicates(["run_id", "start_token", "n_tokens", "loss"])


def corpus_perplexity(df: DataFrame, *by: str) -> DataFrame:
    """n_chunks, n_tokens, ppl by the given columns: e to the mean loss a token; infinite without a token."""
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("loss") * F.col("n_tokens")).alias("nll"))
    return sums.select(*by, "n_chunks", "n_tokens", F.coalesce(F.exp(F.try_divide("nll", "n_tokens")), F.lit(float("inf"))).alias("ppl"))


def compare(df: DataFrame, first: str, second: str) -> DataFrame:
    """corpus, ppl of two checkpoints, their difference and which is better; corpora that only one has are left out."""
    of = lambda c: F.when(F.col("checkpoint") == c, F.col("ppl"))
    both = corpus_perplexity(df.where(F.col("checkpoint").isin(first, second)), "corpus", "checkpoint").groupBy("corpus").agg(F.max(of(first)).alias("ppl_a"), F.max(of(second)).alias("ppl_b"))
    both = both.where("ppl_a is not null and ppl_b is not null").withColumn("delta", F.col("ppl_b") - F.col("ppl_a"))
    return both.withColumn("verdict", F.when(F.col("delta") < 0, "better").when(F.col("delta") > 0, "worse").otherwise("equal"))


def running_best(df: DataFrame, group_col: str, order_col: str, value_col: str) -> DataFrame:
    """df with best_before and improved: the least value earlier in the order, and whether a row's own is below it (as the first is).

    The order is cut into ranges, so a group of a third of all rows is in as many tasks as others.
    """
    rows = df.withColumn("_range", range_of(df, order_col))
    ahead = Window.unboundedPreceding, -1
    inside = F.min(value_col).over(Window.partitionBy(group_col, "_range").orderBy(order_col).rowsBetween(*ahead))
    # the least value of each group in each range, and in the ranges before it: at most MOST_RANGES rows a group
    least = rows.groupBy(F.col(group_col).alias("_group"), F.col("_range").alias("_r")).agg(F.min(value_col).alias("_least"))
    earlier = least.select("_group", "_r", F.min("_least").over(Window.partitionBy("_group").orderBy("_r").rowsBetween(*ahead)).alias("_earlier"))
    joined = rows.withColumn("_inside", inside).join(earlier, F.col(group_col).eqNullSafe(F.col("_group")) & F.col("_range").eqNullSafe(F.col("_r")))
    out = joined.select(*df.columns, F.least("_inside", "_earlier").alias("best_before"))
    return out.withColumn("improved", F.coalesce(F.col(value_col) < F.col("best_before"), F.col(value_col).isNotNull()))


def forgetting(df: DataFrame, baseline: str) -> DataFrame:
    """corpus, checkpoint, ratio to the baseline's perplexity on the corpus, and whether it is over FORGETTING."""
    ppl = corpus_perplexity(df.where("checkpoint is not null"), "corpus", "checkpoint")
    base = ppl.where(F.col("checkpoint") == baseline).select("corpus", F.col("ppl").alias("base"))
    ratio = ppl.join(base, "corpus").withColumn("ratio", F.col("ppl") / F.col("base"))
    return ratio.select("corpus", "checkpoint", "ratio", (F.col("ratio") > FORGETTING).alias("forgets"))

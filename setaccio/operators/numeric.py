"""Blocks of quantised vectors, choices among logits, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Values of a quantised block.
BLOCK = 32


def quantise(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id_col, block, scale, q of each block of 32 values: scale is the largest absolute value over 127 (1 for a block of zeros), q are
    the rounded quotients, half to even, within 127; the last block is filled with zeros. Null values count as zero, null and empty vectors
    have no block.
    """
    v = F.transform(vector_col, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    n = F.ceil(F.size(vector_col) / BLOCK).cast("int")
    padded = F.concat(v, F.array_repeat(F.lit(0.0), n * BLOCK - F.size(vector_col)))
    rows = df.where(F.size(vector_col) > 0).select(id_col, padded.alias("v"), F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    rows = rows.select(id_col, "block", F.slice("v", F.col("block") * BLOCK + 1, BLOCK).alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("scale", F.when(top == 0, 1.0).otherwise(top / 127))
    q = F.transform("v", lambda x: F.greatest(F.least(F.rint(x / F.col("scale")), F.lit(127.0)), F.lit(-127.0)).cast("int"))
    return rows.select(id_col, "block", "scale", q.alias("q"))


def logits(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, token, logit: a vector in long form."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(vector_col).alias("token", "logit")).withColumn("logit", F.col("logit").cast("double"))


def penalise(rows: DataFrame, context: DataFrame, penalty: float) -> DataFrame:
    """Logits of tokens in the context (id, token) divided by the penalty if positive, multiplied if not; each once."""
    seen = context.select("id", "token").distinct().withColumn("seen", F.lit(True))
    lower = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return rows.join(seen, ["id", "token"], "left").select("id", "token", F.when(F.col("seen"), lower).otherwise(F.col("logit")).alias("logit"))


def temper(rows: DataFrame, temperature: float) -> DataFrame:
    return rows.withColumn("logit", F.col("logit") / temperature)


def top_k(rows: DataFrame, k: int) -> DataFrame:
    """Tokens whose logit is at least the k-th highest of their id; ties at the k-th stay."""
    return rows.withColumn("above", F.rank().over(Window.partitionBy("id").orderBy(F.desc("logit")))).where(F.col("above") <= k).drop("above")


def softmax(rows: DataFrame) -> DataFrame:
    """rows with p, the probability of each token of its id."""
    own = Window.partitionBy("id")
    e = rows.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(own)))
    return e.withColumn("p", F.col("e") / F.sum("e").over(own)).drop("e")


def top_p(rows: DataFrame, share: float) -> DataFrame:
    """The likeliest tokens until their probability passes the share, the one that passes it among them; ties go by token."""
    before = Window.partitionBy("id").orderBy(F.desc("logit"), "token").rowsBetween(Window.unboundedPreceding, -1)
    return softmax(rows).withColumn("before", F.coalesce(F.sum("p").over(before), F.lit(0.0))).where(F.col("before") <= share).drop("before")


def cross_entropy(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """id, loss: minus the log probability of the target token (id, token) of each id."""
    log_sum = rows.groupBy("id").agg(F.max("logit").alias("m"), F.collect_list("logit").alias("all"))
    log_sum = log_sum.select("id", (F.col("m") + F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))).alias("log_sum"))
    return rows.join(targets.select("id", "token"), ["id", "token"]).join(log_sum, "id").select("id", (F.col("log_sum") - F.col("logit")).alias("loss"))


def merge_low_rank(weights: DataFrame, a: DataFrame, b: DataFrame, alpha: float, rank: int) -> DataFrame:
    """row, col, value of W + (alpha / rank) B A, all three matrices in long form (row, col, value); missing entries are zero.

    The product is an equi-join on the inner index and a sum, which is aggregated before the shuffle.
    """
    inner = b.select("row", F.col("col").alias("k"), F.col("value").alias("x")).join(a.select(F.col("row").alias("k"), "col", F.col("value").alias("y")), "k")
    product = inner.groupBy("row", "col").agg((F.sum(F.col("x") * F.col("y")) * (alpha / rank)).alias("added"))
    both = weights.join(product, ["row", "col"], "full")
    return both.select("row", "col", (F.coalesce("value", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))).alias("value"))


def learning_rate(step: Column, rate: float, least: float, warm_up: int, steps: int) -> Column:
    """Rising in a line over the warm-up, then falling as a cosine to the least rate, which stays after the last step."""
    done = (step - warm_up) / max(1, steps - warm_up)
    return F.when(step < warm_up, F.lit(rate) * step / max(1, warm_up)).when(step >= steps, F.lit(least)).otherwise(F.lit(least) + 0.5 * (1 + F.cos(F.lit(math.pi) * done)) * (rate - least))

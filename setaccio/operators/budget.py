"""Prefix sums, byte budgets and shards over an explicit order.

A running sum over all rows would put them into one task. Here rows go to ranges of the order column whose bounds are quantiles,
sums run inside each range, and the ranges' totals (a row a range) are added before; only id and size take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges of a prefix sum, at least and at most, and rows a range is meant to have.
RANGES, MOST_RANGES, ROWS = 64, 1024, 1_000_000


def sizes(df: DataFrame, id_col: str, text_col: str, separator: str = "") -> DataFrame:
    """id and bytes (UTF-8, with the separator) of the rows whose id and text aren't null."""
    return df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), (F.octet_length(text_col) + len(separator.encode())).cast("long").alias("bytes"))


def range_of(df: DataFrame, id_col: str, ranges: int | None = None) -> Column:
    """Number of the range that a value of id_col falls into; there are as many as the rows need, unless the number is given.

    Bounds are approximate quantiles, at most MOST_RANGES values on the driver. Beyond RANGES of them a value is looked for among every RANGES-th
    first and then between two of those, so it is compared with some 2 * 64 bounds at most.
    """
    most = max(2, ranges or MOST_RANGES)
    shares = ", ".join(f"{k / most}D" for k in range(1, most))  # as text, which is parsed once
    n, bounds = df.agg(F.count(id_col), F.expr(f"percentile_approx(`{id_col}`, array({shares}), {max(10_000, most)})")).first()
    wanted = ranges or min(MOST_RANGES, max(RANGES, -(-n // ROWS)))
    bounds = sorted(set(bounds or []))
    bounds = bounds[:: max(1, -(-len(bounds) // wanted))]
    if not bounds:
        return F.lit(0)
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col(id_col)))
    if len(bounds) <= RANGES:
        return below(F.array(*map(F.lit, bounds)))
    parts = [bounds[k : k + RANGES] for k in range(0, len(bounds), RANGES)]
    part = below(F.array(*(F.lit(p[0]) for p in parts[1:])))
    return part * RANGES + below(F.element_at(F.array(*(F.array(*map(F.lit, p)) for p in parts)), part + 1))


def prefix_sums(df: DataFrame, id_col: str, value_col: str, ranges: int | None = None) -> DataFrame:
    """df with `before`, the sum of value_col over the rows of lower id, and `rank`, their number.

    Rows of one id are taken in any order among themselves. Ids must not be null; an empty table stays empty.
    """
    rows = df.withColumn("range", range_of(df, id_col, ranges))
    own = Window.partitionBy("range").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("range").alias("r")).agg(F.sum(value_col).alias("total"), F.count(F.lit(1)).alias("rows"))
    over = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)  # over MOST_RANGES rows at most
    offsets = totals.select("r", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("sum_before"), F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows_before"))
    # null-safe, for from a plain equality the optimizer would infer a filter of the other side by the expression of the range, which it can't evaluate there
    out = rows.withColumns({"inside": F.coalesce(F.sum(value_col).over(own), F.lit(0)), "place": F.count(F.lit(1)).over(own)}).join(F.broadcast(offsets), F.col("range").eqNullSafe(F.col("r")))
    return out.withColumns({"before": F.col("inside") + F.col("sum_before"), "rank": F.col("place") + F.col("rows_before")}).drop("range", "r", "inside", "place", "sum_before", "rows_before")


def until_reached(df: DataFrame, id_col: str, text_col: str, most_bytes: int, most_rows: int | None = None) -> DataFrame:
    """id, bytes, before of the rows written until the budget is reached: the last may exceed it, and there is always one."""
    kept = prefix_sums(sizes(df, id_col, text_col), "id", "bytes").where(F.col("before") < most_bytes)
    return (kept if most_rows is None else kept.where(F.col("rank") < most_rows)).select("id", "bytes", "before")


def never_exceed(df: DataFrame, id_col: str, text_col: str, most_bytes: int, skip_bytes: int = 0, separator: str = "\n\n") -> DataFrame:
    """id, bytes, before of the rows written before the first that would exceed the budget; separators count.

    Rows that begin inside the first skip_bytes are skipped, the one that crosses the line too; the budget counts from there.
    """
    rows = prefix_sums(sizes(df, id_col, text_col, separator), "id", "bytes")
    if skip_bytes:
        rows = rows.where(F.col("before") >= skip_bytes)
        start = rows.agg(F.min("before")).first()[0] or 0
        rows = rows.withColumn("before", F.col("before") - F.lit(start))
    return rows.where(F.col("before") + F.col("bytes") <= most_bytes).select("id", "bytes", "before")


def shards(df: DataFrame, id_col: str, text_col: str, cap: int, n_shards: int | None = None, separator: str = "\n\n") -> DataFrame:
    """id, bytes, shard: next-fit shards of at most cap bytes, in order of id.

    A shard is closed by the first row that doesn't fit, which begins the next one; a row over the cap is alone in its shard, and if it is the
    very first, the shard before it is left empty. Unlike a division of
    the running sum by the cap, each shard begins at a row. Where a shard begins follows from where the one before it did, so each row's
    successor (the first row that wouldn't fit a shard beginning there) is found for all rows at once by a merge of two orders,
    and the beginnings reachable from the first row by doubling the steps, in as many rounds as the number of shards has bits.
    """
    from setaccio.plans.tables import cut

    rows = cut(prefix_sums(sizes(df, id_col, text_col, separator), "id", "bytes"))
    ends = rows.select((F.col("before") + F.col("bytes")).alias("at"), F.lit(1).alias("kind"), F.col("rank").alias("rank"))
    asks = rows.select((F.col("before") + F.greatest(F.lit(cap), F.col("bytes"))).alias("at"), F.lit(0).alias("kind"), F.col("rank").alias("rank"))
    # the successor of a beginning is the first row whose end lies behind its limit: ends at the limit still fit and come before it
    merged = ends.withColumn("order", F.struct("at", F.lit(0).alias("k"), "rank")).unionByName(asks.withColumn("order", F.struct("at", F.lit(1).alias("k"), "rank")))
    merged = merged.withColumn("range", range_of(rows.select((F.col("before") + F.col("bytes")).alias("at")), "at"))
    ahead = Window.partitionBy("range").orderBy("order").rowsBetween(1, Window.unboundedFollowing)
    inside = merged.withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("rank"))).over(ahead))
    firsts = merged.where("kind = 1").groupBy("range").agg(F.min("rank").alias("first"))
    later = Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing)  # over MOST_RANGES rows at most
    every = merged.select("range").distinct().join(firsts, "range", "left").select(F.col("range").alias("r"), F.min("first").over(later).alias("first_later"))
    step = cut(inside.where("kind = 0").join(F.broadcast(every), F.col("range").eqNullSafe(F.col("r"))).select("rank", F.coalesce("next", "first_later").alias("next")).where("next is not null"))
    starts = rows.where("rank = 0").select("rank")
    empty = rows.where(f"rank = 0 and bytes > {int(cap)}").count()
    count = None
    while True:
        reached = starts.join(step, "rank").select(F.col("next").alias("rank"))
        starts = cut(starts.unionByName(reached).distinct())
        now = starts.count()
        if now == count:
            break
        count = now
        after = step.select(F.col("rank").alias("next"), F.col("next").alias("after"))
        step = cut(step.join(after, "next").select("rank", F.col("after").alias("next")))
    marked = rows.join(starts.withColumn("begins", F.lit(1)), "rank", "left").withColumn("begins", F.coalesce("begins", F.lit(0)))
    numbered = prefix_sums(marked.drop("before", "rank"), "id", "begins")
    out = numbered.select("id", "bytes", (F.col("before") + F.col("begins") - 1 + F.lit(empty)).cast("int").alias("shard"))
    return out if n_shards is None else out.where(F.col("shard") < n_shards)


def line_shards(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, line_no, shard: every line of every text, in order, cut into n parts of equally many lines, the last one shorter."""
    texts = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(text_col, "\n").alias("lines"))
    counted = prefix_sums(texts.withColumn("n_lines", F.size("lines").cast("long")), "id", "n_lines")
    total = counted.agg(F.sum("n_lines")).first()[0] or 0
    per = max(1, -(-total // n))
    lines = counted.select("id", "before", F.posexplode("lines").alias("pos", "line"))
    return lines.select("id", (F.col("before") + F.col("pos")).alias("line_no"), F.floor((F.col("before") + F.col("pos")) / F.lit(per)).cast("int").alias("shard"))


def tail_split(df: DataFrame, id_col: str, size_col: str, share: float = 0.1) -> DataFrame:
    """df with n_train and n_val: how much of each row's size lies before and in the last int(total * share).

    Where that is zero nothing is held out and everything is for training.
    """
    rows = prefix_sums(df, id_col, size_col)
    total = rows.agg(F.sum(size_col)).first()[0] or 0
    border = F.lit(total - int(total * share))
    train = F.least(F.greatest(border - F.col("before"), F.lit(0)), F.col(size_col))
    return rows.withColumn("n_train", train).withColumn("n_val", F.col(size_col) - train).drop("before", "rank")

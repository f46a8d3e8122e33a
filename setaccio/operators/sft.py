"""Prompt and completion pairs: validity, encoding, masks, batches, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from setaccio.operators.budget import prefix_sums

#: Label of a position that isn't learnt from, and the id inputs are padded with.
MASKED, PAD = -100, 0
#: Completion tokens that must fit behind a prompt.
LEAST_BUDGET = 4


def pairs_from_lines(df: DataFrame, line_col: str) -> DataFrame:
    """prompt, completion and reason of each line of JSON: blank, bad_json, missing_key, or null for a pair."""
    line = F.trim(line_col)
    json = F.try_parse_json(line)
    prompt, completion = (F.try_variant_get(json, f"$.{k}", "string") for k in ("prompt", "completion"))
    reason = F.when((line == "") | line.isNull(), "blank").when(json.isNull(), "bad_json").when(prompt.isNull() | completion.isNull(), "missing_key")
    return df.select(prompt.alias("prompt"), completion.alias("completion"), reason.alias("reason"))


def completion_reason(prompt: Column, completion: Column) -> Column:
    """Why a pair can't be learnt from: missing_prompt, missing_completion, bad_json (the completion), no_intent, or null."""
    json = F.try_parse_json(completion)
    return (
        F.when(F.coalesce(prompt, F.lit("")) == "", "missing_prompt").when(F.coalesce(completion, F.lit("")) == "", "missing_completion").when(json.isNull(), "bad_json").when(F.get_json_object(completion, "$.intent").isNull(), "no_intent")
    )


def encode_pairs(df: DataFrame, id_col: str, prompt_ids: str, completion_ids: str, most: int, end_id: int | None = None) -> DataFrame:
    """id_col, input_ids, targets of pairs cut to `most` tokens.

    The end id is the completion's last. Where both together are too long the completion is cut; a pair whose prompt leaves
    fewer than LEAST_BUDGET tokens, or whose completion is empty, is dropped. Targets are the inputs moved on by one, masked on the prompt.
    """
    p, c = F.col(prompt_ids), F.col(completion_ids)
    if end_id is not None:
        c = F.concat(c, F.array(F.lit(end_id)))
    rows = df.where(F.size(completion_ids) > 0).select(id_col, p.alias("p"), c.alias("c")).withColumn("room", most - F.size("p"))
    rows = rows.where((F.size("p") + F.size("c") <= most) | (F.col("room") >= LEAST_BUDGET)).withColumn("c", F.slice("c", 1, F.greatest(F.col("room"), F.lit(0))))
    masked = F.array_repeat(F.lit(MASKED), F.greatest(F.size("p") - 1, F.lit(0)))
    return rows.select(id_col, F.concat("p", "c").alias("input_ids"), F.concat(masked, "c", F.array(F.lit(MASKED))).alias("targets"))


def batches(df: DataFrame, order_col: str, size: int) -> DataFrame:
    """input_ids and targets with their batch in the given order, both padded to the batch's longest."""
    numbered = prefix_sums(df.withColumn("one", F.lit(1).cast("long")), order_col, "one").withColumn("batch", F.floor(F.col("rank") / F.lit(size)))
    longest = numbered.groupBy("batch").agg(F.max(F.size("input_ids")).alias("longest"))
    rows = numbered.join(longest, "batch")
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("longest") - F.size(c)))
    return rows.select(order_col, "batch", pad("input_ids", PAD).alias("input_ids"), pad("targets", MASKED).alias("targets"))


def shuffled(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """df with `place`, each row's position (0, 1, ...) in a random but repeatable order, by a hash of the id and the seed."""
    keyed = df.withColumns({"key": F.xxhash64(id_col, F.lit(seed)), "one": F.lit(1).cast("long")})
    return prefix_sums(keyed, "key", "one").withColumnRenamed("rank", "place").drop("key", "one", "before")


def masked_mean(df: DataFrame, loss_col: str, target_col: str) -> DataFrame:
    """Mean loss of the positions that aren't masked; null if none is."""
    return df.where(F.col(target_col) != MASKED).agg(F.avg(loss_col).alias("loss"), F.count(F.lit(1)).alias("n"))


def slots(df: DataFrame, id_col: str, completion_col: str) -> DataFrame:
    """id_col, slot, value of each slot of a completion that is a JSON object; lists give a row an element, nulls none.

    What a value is, is told by its JSON type, so a string that begins with a bracket is a string.
    """
    pairs = df.select(id_col, F.explode(F.from_json(completion_col, "map<string,variant>")).alias("slot", "raw"))
    values = F.when(F.schema_of_variant("raw").startswith("ARRAY"), F.try_variant_get("raw", "$", "array<string>")).otherwise(F.array(F.try_variant_get("raw", "$", "string")))
    return pairs.select(id_col, "slot", F.explode(values).alias("value")).where("value is not null")


def encode_slots(c: Column) -> Column:
    """A JSON object without its null-valued slots, keys in order; lists, numbers and nested objects stay what they are."""
    kept = F.map_filter(F.from_json(c, "map<string,variant>"), lambda k, v: ~F.is_variant_null(v))
    keys = F.array_sort(F.map_keys(kept))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(kept, k))))

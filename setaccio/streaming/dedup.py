"""Curation of a stream: rules, then the first of each text, over any number of small batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from setaccio.operators import filters
from setaccio.plans.tables import new_path


def distinct_texts(stream: DataFrame, text_col: str, event_col: str | None = None, delay: str | None = None) -> DataFrame:
    """A stream's rows whose text is met for the first time.

    With an event time and a delay a digest is forgotten once the watermark has passed it, so the state is bounded by what arrives
    within the delay; without them it grows with the distinct texts, a digest each.
    """
    rows = stream.where(F.col(text_col).isNotNull()).withColumn("digest", F.md5(text_col))
    if event_col and delay:
        return rows.withWatermark(event_col, delay).dropDuplicatesWithinWatermark(["digest"]).drop("digest")
    return rows.dropDuplicates(["digest"]).drop("digest")


def curate(stream: DataFrame, text_col: str, min_words: int = filters.MIN_WORDS) -> DataFrame:
    """A stream's rows whose text keeps the rules and is met for the first time."""
    return distinct_texts(filters.heuristic(stream, text_col, min_words), text_col)


def run_available(spark: SparkSession, out: DataFrame) -> DataFrame:
    """What a stream gives of the data there is now, as a table; its state and place are kept beside it."""
    path = new_path(spark)
    query = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def merge_new(spark: SparkSession, stream: DataFrame, id_col: str, text_col: str, seen_path: str):
    """Writes each batch's texts whose digest isn't in the table at seen_path, lowest id first, and adds their digests to it."""

    def batch(df: DataFrame, number: int) -> None:
        new = df.where(F.col(text_col).isNotNull()).groupBy(F.md5(text_col).alias("digest")).agg(F.min(F.struct(id_col, text_col)).alias("r")).select("digest", "r.*")
        folder = spark._jvm.org.apache.hadoop.fs.Path(seen_path)
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            seen = spark.read.parquet(seen_path).where(F.col("batch") != number)  # a batch run again writes its part again
            new = new.join(seen.select("digest"), "digest", "left_anti")  # only the digests are read
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(seen_path)

    return stream.writeStream.foreachBatch(batch)

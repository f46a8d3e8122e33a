"""Writing corpora, shards, tables and token caches."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType


def write_corpus(df: DataFrame, path: str, text_col: str = "text", mode: str = "overwrite") -> None:
    """Each text and an empty line."""
    df.select(text_col).write.mode(mode).option("lineSep", "\n\n").text(path)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", text_col: str = "text") -> None:
    """A directory a shard; rows of a shard meet in one file each task has of it."""
    df.select(shard_col, text_col).write.mode("overwrite").partitionBy(shard_col).option("lineSep", "\n\n").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_chunks(df: DataFrame, path: str) -> None:
    """start_token, n_tokens, loss, ppl as CSV with a header."""
    df.select("start_token", "n_tokens", "loss", "ppl").write.mode("overwrite").option("header", True).csv(path)


def dry_run(df: DataFrame) -> int:
    """Rows that would be written; everything but the writing is done, once."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]


@F.pandas_udf(StringType())
def tenths(s: pd.Series) -> pd.Series:
    """With one decimal place, rounded by the exact binary value (the JVM's formats round its shortest decimal form)."""
    return s.map(lambda v: f"{v:.1f}", na_action="ignore")


def reject_sample(df: DataFrame, order_col: str, ppl_col: str, text_col: str, n: int = 500, chars: int = 600) -> DataFrame:
    """The first n rows in order, a report of each: its perplexity and the head of its text."""
    report = F.concat(F.lit("=== PPL "), tenths(ppl_col), F.lit(" ===\n"), F.substring(text_col, 1, chars))
    return df.orderBy(order_col).limit(n).select(order_col, report.alias("report"))


def fingerprint(df: DataFrame, key: str) -> str:
    """Of the files behind df (names, sizes, times of change) and a tokenizer's key."""
    spark = df.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs
    found = []
    for name in sorted(df.inputFiles()):
        path = fs.Path(name)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join([key, *found]).encode()).hexdigest()


def cached_tokens(spark: SparkSession, folder: str, source: DataFrame, key: str, make) -> DataFrame:
    """The table that make() gives, written once for a source's files and a key; a change of either makes it anew."""
    path = f"{folder.rstrip('/')}/tokens-{fingerprint(source, key)}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Corpora as rows: blocks of text files, articles of an extractor's output, lines of JSON, tables of other systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from setaccio.functions import text as T
from setaccio.functions.udf import wikitext


def text_blocks(spark: SparkSession, path: str) -> DataFrame:
    """text of each block between blank lines, the last one too, stripped and not empty."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(T.strip(F.col("value")).alias("text"))
    return blocks.where("text != ''")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of each file, recursively."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def article_files(spark: SparkSession, path: str, min_chars: int = 500) -> DataFrame:
    """path, pos, text of each article, of at least min_chars before cleaning, in an extractor's files."""
    return explode_articles(whole_texts(spark, path), "text", min_chars)


def explode_articles(df: DataFrame, text_col: str, min_chars: int = 500) -> DataFrame:
    """The other columns with pos and text of each article in a column of an extractor's output."""
    others = [c for c in df.columns if c != text_col]
    rows = df.select(*others, F.posexplode(T.articles(F.col(text_col))).alias("pos", "text"))
    return rows.where(F.length("text") >= min_chars)


def wiki_dump(spark: SparkSession, path: str, plain: bool = True) -> DataFrame:
    """page_id, title, text (plain, or wikitext as it is) of each page of an XML dump that isn't a redirect; pages are split across tasks."""
    schema = "id bigint, title string, ns int, redirect string, revision struct<text:string>"
    pages = spark.read.schema(schema).option("rowTag", "page").format("xml").load(path)
    return pages.where("redirect is null and coalesce(ns, 0) = 0").select(F.col("id").alias("page_id"), "title", (wikitext("revision.text") if plain else F.col("revision.text")).alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str = "prompt string, completion string") -> DataFrame:
    """Rows of a file of JSON lines, with the line in `corrupt` where it can't be read."""
    return spark.read.schema(schema + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)


def vocabulary_file(spark: SparkSession, path: str) -> DataFrame:
    """id, piece, score of a tab-separated vocabulary in the order of its lines (one file)."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+\z", ""), "\n")).alias("id", "line"))
    return lines.select("id", F.split_part("line", F.lit("\t"), F.lit(1)).alias("piece"), F.split_part("line", F.lit("\t"), F.lit(2)).cast("double").alias("score"))


def field(df: DataFrame, path: str, min_chars: int = 0) -> DataFrame:
    """text of a column, of a field in a struct, or of a path in a JSON column; null, empty and short ones are left out."""
    head, _, rest = path.partition(".")
    nested = rest and df.schema[head].dataType.typeName() == "string"
    value = T.field_path(F.col(head), rest) if nested else F.col(path)
    return df.select(T.strip(value.cast("string")).alias("text")).where((F.col("text") != "") & (F.length("text") >= min_chars))


def jdbc_query(spark: SparkSession, url: str, query: str, column: str | None = None, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """text of a column of a query run by a database (its only column if none is named); markup is stripped where a text begins with it.

    split: a numeric column, its lowest and highest value and the number of connections that read the ranges between them; without it one connection reads
    everything, `fetchsize` rows at a time.
    """
    options = {"fetchsize": "10000"} | options
    if split:
        column_, low, high, n = split
        options |= {"dbtable": f"({query}) q", "partitionColumn": column_, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    else:
        options |= {"query": query}
    rows = spark.read.format("jdbc").options(url=url, **options).load()
    if column is None and len(rows.columns) != 1:
        raise ValueError(f"the query has the columns {rows.columns}: name one")
    return rows.select(T.clean_basic(T.strip_markup(F.col(column or rows.columns[0]).cast("string"))).alias("text"))


def mongo_collection(spark: SparkSession, uri: str, collection: str, text_field: str, pipeline: str | None = None) -> DataFrame:
    """text of a field of a collection's documents, filtered by the server; needs the MongoDB connector on the class path."""
    reader = spark.read.format("mongodb").option("connection.uri", uri).option("collection", collection)
    rows = (reader.option("aggregation.pipeline", pipeline) if pipeline else reader).load()
    return rows.select(T.clean_basic(F.col(text_field).cast("string")).alias("text"))


def open_source(spark: SparkSession, config: dict) -> DataFrame:
    """One source of a list by its type: parquet, json, csv, text, postgresql or mongodb. An unknown type is an error."""
    kind, least = config.get("type"), int(config.get("min_chars", 0))
    if kind in ("parquet", "json", "csv"):
        rows = spark.read.option("header", "true").format(kind).load(config["path"])
        if config.get("filter"):
            rows = rows.where(config["filter"])
        if config.get("lang_field"):
            rows = rows.where(F.col(config["lang_field"]) == config["lang"])
        return field(rows, config["text_field"], least)
    if kind == "text":
        out = text_blocks(spark, config["path"])
    elif kind == "postgresql":
        out = jdbc_query(spark, config["url"], config["query"], config.get("text_field"))
    elif kind == "mongodb":
        out = mongo_collection(spark, config["url"], config["collection"], config["text_field"], config.get("filter"))
    else:
        raise ValueError(f"unknown type {kind}")
    return out.where(F.length("text") >= least)


def union_sources(spark: SparkSession, configs: list[dict]) -> tuple[DataFrame, list[tuple[int, str]]]:
    """(source, text of all sources that can be opened; number and error of those that can't). Opening one reads its schema."""
    opened, errors = [], []
    for k, config in enumerate(configs):
        try:
            one = open_source(spark, config).withColumn("source", F.lit(k))
            one.schema  # noqa: B018
            opened.append(one.select("source", "text"))
        except Exception as e:  # a source that fails doesn't end the others
            errors.append((k, f"{type(e).__name__}: {e}"[:300]))
    out = spark.createDataFrame([], "source int, text string")
    for one in opened:
        out = out.unionByName(one)
    return out, errors

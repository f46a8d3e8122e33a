"""Exact duplicates: paragraphs, blocks and documents, the first in order staying."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from setaccio.functions import text as T


def first_paragraphs(df: DataFrame, id_col: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """id, pos, para of the first occurrence, in order of id and place, of each distinct paragraph.

    The first is a minimum per digest, which is aggregated before the shuffle, so a paragraph that a third of all documents share
    costs one row a task; the text of a paragraph is not shuffled, only its digest and place. Null texts and ids are left out.
    """
    one = df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    paras = one.select(F.col(id_col).alias("id"), F.posexplode(T.paragraphs(F.col(text_col), separator)).alias("pos", "para"))
    return paras.groupBy(F.md5("para").alias("digest")).agg(F.min(F.struct("id", "pos")).alias("m")).select("m.id", "m.pos")


def paragraph_dedup(df: DataFrame, id_col: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """id_col and text_col rebuilt from the paragraphs met for the first time; documents left empty are dropped.

    The kept places of a document are joined back to it, so its text crosses the network once.
    """
    kept = first_paragraphs(df, id_col, text_col, separator).groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("kept"))
    paras = T.paragraphs(F.col(text_col), separator)
    joined = df.select(F.col(id_col).alias("id"), text_col).join(kept, "id")
    return joined.select(F.col("id").alias(id_col), F.array_join(F.transform("kept", lambda p: F.get(paras, p)), separator).alias(text_col))


def block_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents cut at blank lines, each block a row (id, pos, text) if it is met for the first time."""
    first = first_paragraphs(df, id_col, text_col, "\n\n")
    blocks = df.select(F.col(id_col).alias("id"), F.posexplode(T.paragraphs(F.col(text_col), "\n\n")).alias("pos", "text"))
    return blocks.join(first, ["id", "pos"]).withColumnRenamed("id", id_col)


def exact_dedup(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lowest id of each distinct text that isn't null, and how many rows have it."""
    return df.where(F.col(text_col).isNotNull()).groupBy(F.md5(text_col).alias("digest")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n"))


def repeated_paragraphs(df: DataFrame, id_col: str, text_col: str, separator: str = "\n\n") -> DataFrame:
    """digest, occurrences, documents and first document of paragraphs that occur more than once."""
    paras = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(T.paragraphs(F.col(text_col), separator)).alias("para"))
    by_doc = paras.groupBy(F.md5("para").alias("digest"), "id").agg(F.count(F.lit(1)).alias("n"))
    return by_doc.groupBy("digest").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"), F.min("id").alias("first_id")).where("n > 1")


def quota(df: DataFrame, group_col: str, text_col: str, order_col: str, length: int, most: int) -> DataFrame:
    """For each group the first `most` rows, in order, of distinct prefixes of `length` characters.

    Each prefix's first row is a minimum aggregated before the shuffle; only those are numbered.
    """
    cols = [c for c in df.columns if c not in (group_col, order_col)]
    prefix = F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, length)
    first = df.groupBy(group_col, prefix.alias("prefix")).agg(F.min(F.struct(order_col, *cols)).alias("r"))
    numbered = first.select(group_col, "r.*").withColumn("rank", F.row_number().over(Window.partitionBy(group_col).orderBy(order_col)))
    return numbered.where(F.col("rank") <= most)

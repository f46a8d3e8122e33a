"""Reading tables and cutting lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folders of this process's written tables.
_written: list[str] = []


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it; elsewhere it comes with --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, env.get("PYTHONPATH"))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it. Where it is unset a local one is made for a local master; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="setaccio-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A folder of its own for a table in the shared folder."""
    _written.append(f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    return _written[-1]


def clear(spark: SparkSession) -> int:
    """Removes the tables written so far; call it when their results have been used. Gives how many there were."""
    n = len(_written)
    for where in _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _written.clear()
    return n


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that it runs once and a lost executor doesn't undo it."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

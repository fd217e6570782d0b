"""Intermediate tables in the folder that the driver and all executors share, and values that are evaluated once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared one (spark.checkpoint.dir), or under a temporary one where that is unset and Spark is local. It goes when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/scratch-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are evaluated once a row. Spark writes a projected column out again in each filter and each expression that names it; one that a generator gives, it does not."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def fenced(df: DataFrame) -> DataFrame:
    """df, of which no filter is pushed down and no column taken away by what reads it: plans that read it several times have equal parts below, whose shuffles Spark makes once."""
    return once(df, {c: F.col(c) for c in df.columns})


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def saved(df: DataFrame) -> DataFrame:
    """df, written once and read again: lineage ends here, and a lost executor costs nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

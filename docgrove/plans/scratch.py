"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the one that the cluster shares (spark.checkpoint.dir); a local one only in a single process without any."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        of_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = of_context.get() if of_context.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="docgrove-")
    return f"{where.rstrip('/')}/docgrove/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read from there: what is used often is made once, and survives lost executors."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)

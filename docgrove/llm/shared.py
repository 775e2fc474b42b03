"""Helpers of the operators around DataFrames: inputs, widths, durable intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words without white space, and white space, as the contracts spell them.
SOLID_WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"


BATCH_ROWS = 256
#: Bits of a filter over document ids, at most.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of the tables made in the innermost scope.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only in one process (tests), a local one where none is named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm_dir.get() if jvm_dir.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="docgrove-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _written(df: DataFrame, label: str, made: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docgrove/{label}-{uuid.uuid4().hex}"
    spark.sparkContext._jvm.System.gc()
    if made is not None:
        made.append(path)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    While it is written, Arrow batches hold BATCH_ROWS rows, for texts may be long.
    Before, the driver's garbage is collected, for only then does Spark delete the
    shuffle files that led to earlier tables.  Inside ``scratch`` the table lives as long as
    the scope; elsewhere, until the folder is cleared.
    """
    return _written(df, label, _made.get())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose durable tables are deleted at its end, also after an error.

    Gives a function like ``durable`` whose tables outlive the scope: they belong to
    the scope around it.  What leaves the scope must read no other of its tables.
    """
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        yield lambda df, label: _written(df, label, outer)
    finally:
        _made.reset(token)
        for path in own:
            remove(spark, path)
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def unused_name(name: str, *tables: DataFrame) -> str:
    """name, lengthened until no column of the tables is called so in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def word_count(text: Column) -> Column:
    """Number of words without white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SOLID_WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap over xxhash64(doc_id) of bounded size; true for all ids of the table and some others."""
    return hash_filter(ids.select(F.xxhash64("doc_id").alias("hash")))


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS at most over the column `hash` (bigint); true for all of them and some others."""
    n = hashes.count()
    bits = 1 << 16
    while bits < min(FILTER_BITS, 8 * n):
        bits *= 2
    place = F.pmod("hash", F.lit(bits).cast("long"))
    words = hashes.select(place.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("mask"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out


def in_filter(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def suspect(bitmap: np.ndarray):
    """A function of hash columns: whether the bitmap may hold the id."""

    @F.pandas_udf("boolean")
    def test(h: pd.Series) -> pd.Series:
        return pd.Series(in_filter(bitmap, h.to_numpy(dtype=np.int64)))

    return test


#: Distinct ids that are broadcast, at eight bytes each and what a hash table adds.
BROADCAST_IDS = 1 << 20


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs less the rows whose doc_id is in drop (distinct ids, stored).

    Up to BROADCAST_IDS ids are broadcast.  Beyond, only rows that a bounded filter over
    the ids catches are joined with them.  Either way the other rows pass without a
    shuffle of their texts.
    """
    gone = unused_name("dropped_id", docs)
    ids, same = drop.select(F.col("doc_id").alias(gone)), F.col("doc_id") == F.col(gone)
    if drop.count() <= BROADCAST_IDS:
        return docs.join(F.broadcast(ids), same, "left_anti")
    flag = suspect(id_filter(drop))(F.xxhash64(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))))
    return docs.filter(~flag).unionByName(docs.filter(flag).join(ids, same, "left_anti"))

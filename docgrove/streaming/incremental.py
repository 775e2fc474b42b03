"""An incremental indexer (an extension): new Markdown files are chunked and upserted as they arrive.

Spark's file source reads each path once; a changed file comes in under a new name, or by a reindex.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.tokens import TokenCap
from ..plans.engine import embed_chunks, parse
from ..plans.index import VectorIndex, to_records
from ..plans.scratch import stored
from ..sources.files import Source, select_files
from ..sources.remote import described

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def index_stream(spark: SparkSession, source: Source, index: VectorIndex, embedder, checkpoint: str, cap: TokenCap | None = None) -> StreamingQuery:
    """Works off what has arrived since the last run, then stops; each batch is one upsert of whole files."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(source.path)
    path = F.substring_index("path", source.path.rstrip("/") + "/", -1)
    files = select_files(raw.select(path.alias("path"), F.decode("content", "utf-8").alias("content")), source.parser, source.skip_dirs, source.skip_files)
    rows = described(files, source)

    def upsert(batch: DataFrame, _: int) -> None:
        found = stored(parse(batch, source), "stream")
        failed = found.filter("error is not null").select("file").distinct()
        # what a file held before goes, also where it holds less now; a file that fails stays as it was
        files = batch.select(F.lit(source.name).alias("source"), F.col("path").alias("file")).distinct().join(failed, "file", "left_anti")
        chunks = found.filter("error is null").drop("error")
        index.replace(to_records(embed_chunks(chunks, embedder, cap), keep=("source", "file")), [], files=files)

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

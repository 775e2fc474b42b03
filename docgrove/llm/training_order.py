"""Token-ID output in training order.

Documents are encoded once and cut into sequences of SEQUENCE tokens (an end-of-text
token closes each document and pads its last sequence).  The sequences are stored
and numbered 0..N-1; a keyed Feistel network over the least even-bit domain that
holds N, walked along its cycle until it lands below N, gives each its global slot.
Ranges of slots become shards, and ranges of shards partitions: every record has the
same stride, so slot s is at byte (s mod SHARD_RECORDS) * stride of shard
s div SHARD_RECORDS, and a reader may resume at any slot.

``training_shards`` returns the shards as rows.  ``write_shards`` writes each as one
file of fixed-stride records (FILE_STRIDE bytes: the token ids, and a newline that
Spark's writer sets behind every record), from which ``read_records`` seeks.

Inputs and edge cases
* null and empty texts give one sequence that holds the end-of-text token alone.
* null doc_id is carried as null; repeated rows each give their sequences.
* an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .encoding import END_OF_TEXT, TOKENIZERS, packed_ranks, worker_encoder
from .shared import durable

SEQUENCE = 256
SHARD_RECORDS = 4096
ROUNDS = 6
KEY = 0x5EED
STRIDE = 2 * SEQUENCE
FILE_STRIDE = STRIDE + 1

SEQUENCES = "task int, task_no bigint, doc_id bigint, part bigint, n_tokens int, tokens binary"
SHARDS = "shard bigint, first_slot bigint, n_records bigint, stride int, doc_ids array<bigint>, parts array<bigint>, n_tokens array<int>, payload binary"


def feistel(x: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of 0..size-1, applied to x."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = tk.mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (tk.mix64(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while True:
        outside = out >= np.uint64(size)
        if not outside.any():
            return out.astype(np.int64)
        out[outside] = once(out[outside])


def sequences(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Stored sequences, numbered within the task that made them."""
    packed = packed_ranks(tokenizers)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, no = worker_encoder(packed), TaskContext.get().partitionId(), 0
        for batch in batches:
            for s in tk.slices(batch.column(1)):
                ids, first = encoder.encode(s)
                n = np.diff(first) + 1  # with the end of text
                parts = -(-n // SEQUENCE)
                ahead = np.cumsum(parts) - parts
                total = int(parts.sum())
                grid = np.full(total * SEQUENCE, END_OF_TEXT, np.uint16)
                grid[np.arange(len(ids)) + np.repeat(ahead * SEQUENCE - first[:-1], n - 1)] = ids
                part = np.arange(total) - np.repeat(ahead, parts)
                held = np.minimum(np.repeat(n, parts) - part * SEQUENCE, SEQUENCE)
                doc = batch.column(0).slice(s.first, s.rows()).take(pa.array(np.repeat(np.arange(s.rows()), parts)))
                tokens = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(np.arange(total + 1, dtype=np.int32) * np.int32(STRIDE)), pa.py_buffer(grid)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(total, task), pa.int32()), pa.array(np.arange(no, no + total), pa.int64()), doc, pa.array(part, pa.int64()), pa.array(held, pa.int32()), tokens],
                    names=["task", "task_no", "doc_id", "part", "n_tokens", "tokens"],
                )
                no += total

    return durable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(rows, SEQUENCES), "sequences")


def ranged_slots(docs: DataFrame, key: int = KEY, shard_records: int = SHARD_RECORDS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """shard, slot and the stored columns of every sequence, in slot order within partitions of whole shards."""
    stored = sequences(docs, tokenizers)
    spark = docs.sparkSession
    # one count per task: bounded by the number of input partitions
    counts = {r["task"]: r["n"] for r in stored.groupBy("task").agg(F.max("task_no").alias("n")).collect()}
    offset, total = np.zeros(max(counts, default=0) + 1, np.int64), 0
    for task in sorted(counts):
        offset[task] = total
        total += counts[task] + 1

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                index = offset[b.column(0).to_numpy()] + b.column(1).to_numpy()
                slot = feistel(index, total, key)
                yield pa.RecordBatch.from_arrays([pa.array(slot // shard_records), pa.array(slot), *[b.column(k) for k in range(2, 6)]], names=["shard", "slot", "doc_id", "part", "n_tokens", "tokens"])

    placed = stored.mapInArrow(slots, "shard bigint, slot bigint, doc_id bigint, part bigint, n_tokens int, tokens binary")
    n_shards = max(1, -(-total // shard_records))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_shards)
    ranged = placed.repartitionById(parts, F.floor(F.col("shard") * parts / n_shards).cast("int"))
    return ranged.sortWithinPartitions("shard", "slot").select("shard", "slot", "doc_id", "part", "n_tokens", "tokens")


def training_shards(docs: DataFrame, key: int = KEY, shard_records: int = SHARD_RECORDS, tokenizers: str = TOKENIZERS) -> DataFrame:
    """SHARDS: one row per shard, its payload being fixed-stride records in slot order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for b in batches:
            ids = b.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(ids, prepend=ids[0])) if len(ids) else []
            for a, z in zip([0, *cut], [*cut, len(ids)]):
                if a == z:
                    continue
                if current is not None and ids[a] != current:
                    yield _shard(held, shard_records)
                    held = []
                current = ids[a]
                held.append(b.slice(a, z - a))
        if held:
            yield _shard(held, shard_records)

    return ranged_slots(docs, key, shard_records, tokenizers).mapInArrow(shards, SHARDS)


def _shard(held: list[pa.RecordBatch], shard_records: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(held).combine_chunks()
    slot = t["slot"].to_numpy()
    if len(slot) and not (np.diff(slot) == 1).all():
        raise ValueError("a shard's slots have a gap")
    payload = b"".join(t["tokens"].to_pylist())
    one = lambda name, kind: pa.array([t[name].to_pylist()], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [pa.array([slot[0] // shard_records], pa.int64()), pa.array([slot[0]], pa.int64()), pa.array([len(slot)], pa.int64()), pa.array([STRIDE], pa.int32()), one("doc_id", pa.int64()), one("part", pa.int64()), one("n_tokens", pa.int32()), pa.array([payload], pa.binary())],
        names=["shard", "first_slot", "n_records", "stride", "doc_ids", "parts", "n_tokens", "payload"],
    )


def write_shards(docs: DataFrame, folder: str, key: int = KEY, shard_records: int = SHARD_RECORDS, tokenizers: str = TOKENIZERS) -> None:
    """Writes folder/shard=K, each one file of fixed-stride records in slot order."""
    records = ranged_slots(docs, key, shard_records, tokenizers).select("shard", F.col("tokens").cast("string").alias("record"))
    records.write.partitionBy("shard").option("lineSep", "\n").option("compression", "none").text(folder)


def read_records(spark: SparkSession, folder: str, first: int, last: int, shard_records: int = SHARD_RECORDS) -> Iterator[np.ndarray]:
    """Token ids of slots first..last-1 of written shards: seeks to the first, then reads on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while first < last:
        shard = first // shard_records
        stop = min(last, (shard + 1) * shard_records)
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
        store = path.getFileSystem(conf)
        files = [f for f in store.listStatus(path) if f.getPath().getName().startswith("part-")]
        if len(files) != 1:
            raise ValueError(f"shard {shard} has {len(files)} files")
        stream = store.open(files[0].getPath())
        try:
            stream.seek((first - shard * shard_records) * FILE_STRIDE)
            for _ in range(first, stop):
                record = bytes(stream.readNBytes(FILE_STRIDE))
                if len(record) < FILE_STRIDE:
                    return
                yield np.frombuffer(record, np.uint16, SEQUENCE)
        finally:
            stream.close()
        first = stop


def op10_query(docs: DataFrame) -> DataFrame:
    found = training_shards(docs)
    return found.select("shard", "first_slot", "n_records", "stride", "doc_ids", "parts", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_tokens"), F.sha2("payload", 256).alias("payload_sha256"))

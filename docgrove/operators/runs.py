"""Greedy packing of ordered items into runs, also where one key has more items than a task holds.

Items of a key follow each other; a run takes items as long as their sizes add up to
no more than a limit, and an item above the limit is a run of its own.  Where a run
begins depends on all items before, so a fold per key would be sequential.  Here the
items are sorted by range over the tasks, and a task sums up its stretch of a key:

* prefix sums give every item the start of the run behind the one that begins with it,
  by binary search;
* jumping along these pointers, twice as far each time, gives the last run of the
  stretch for each start, and the number of runs on the way;
* only items within one limit of the stretch's beginning can be its first start, so the
  summary is a short table from the size that the open run brings along to the size
  that it leaves.

A task takes its stretch by pieces of PIECE items at most, and joins their summaries.
The summaries of a key, one per stretch, are followed in order; then each stretch
numbers its own items, again by pieces.  Only keys, places and sizes move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.scratch import shared_folder

#: Items that a task works on at once, at most.
PIECE = 1 << 14
SUMMARY = "n bigint, total bigint, reach array<bigint>, leaves array<bigint>, runs array<bigint>"


def next_starts(prefix: np.ndarray, limit: int) -> np.ndarray:
    """For each item the start of the run behind the one that begins with it; the number of items if there is none."""
    n = len(prefix) - 1
    # sizes are not negative, so the first place behind which a run is too large is found by search
    return np.maximum(np.searchsorted(prefix, prefix[:-1] + limit, "right") - 1, np.arange(1, n + 1))


def summary(sizes: np.ndarray, limit: int) -> tuple[int, int, list[int], list[int], list[int]]:
    """(n, total, reach, leaves, runs) of a stretch.

    A run that brings c along ends at the first candidate whose reach is below c (reach
    falls); from there the stretch leaves an open run of size `leaves` behind `runs` starts.
    """
    n, prefix = len(sizes), np.append(0, np.cumsum(sizes))
    to = next_starts(prefix, limit)
    last, count = np.where(to < n, to, np.arange(n)), (to < n).astype(np.int64)
    while True:
        further = last[last]
        if (further == last).all():
            break
        count += count[last]
        last = further
    candidates = np.flatnonzero((prefix[:-1] <= limit) & (np.diff(prefix, prepend=-1)[1:] != 0) | (np.arange(n) == 0))
    candidates = candidates[: int(np.searchsorted(prefix[1:][candidates], limit, "right")) + 1]
    return n, int(prefix[-1]), (limit - prefix[1:][candidates]).tolist(), (prefix[-1] - prefix[last[candidates]]).tolist(), (1 + count[candidates]).tolist()


def together(a: tuple, b: tuple) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """The summary of a stretch and the one behind it, from their summaries."""
    n, total, reach, leaves, runs = a[0], a[1], *(np.asarray(x, np.int64) for x in a[2:])
    reach_b, leaves_b, runs_b = (np.asarray(x, np.int64) for x in b[2:])
    # what each start of the first leaves is brought along to the second, where it ends or goes on
    which = np.searchsorted(-reach_b, -leaves, "right")
    ends, at = which < len(reach_b), np.minimum(which, len(reach_b) - 1)
    leaves, runs = np.where(ends, leaves_b[at], leaves + b[1]), np.where(ends, runs + runs_b[at], runs)
    if reach[-1] >= 0:
        # a run that passes all of the first ends in the second
        further = reach_b - total
        upto = int(np.searchsorted(-further, 0, "right")) + 1
        reach, leaves, runs = np.append(reach, further[:upto]), np.append(leaves, leaves_b[:upto]), np.append(runs, runs_b[:upto])
    return n + b[0], total + b[1], reach, leaves, runs


def first_start(sizes: np.ndarray, carry: int | None, limit: int) -> int:
    """The first item that an open run of size `carry` does not take; item 0 if there is no open run."""
    return 0 if carry is None else int(np.searchsorted(np.cumsum(sizes), limit - carry, "right"))


def number(sizes: np.ndarray, carry: int | None, limit: int) -> np.ndarray:
    """Numbers of the items' runs; 0 is the open run that is brought along, where there is one, else the first."""
    n, prefix = len(sizes), np.append(0, np.cumsum(sizes))
    to, at, starts = next_starts(prefix, limit).tolist(), first_start(sizes, carry, limit), []
    while at < n:
        starts.append(at)
        at = to[at]
    marks = np.zeros(n, np.int64)
    marks[starts] = 1
    return np.cumsum(marks) - (carry is None)


def number_on(sizes: np.ndarray, carry: int | None, limit: int) -> tuple[np.ndarray, int]:
    """``number``, and the size of the run that is open behind the items."""
    found = number(sizes, carry, limit)
    last = found[-1]
    return found, int(sizes[found == last].sum()) + (carry if carry is not None and last == 0 else 0)


def _pieces(batches: Iterator[pa.RecordBatch], upto: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Rows that agree in their first `upto` columns, by which they are sorted, PIECE at most; and whether they are the first of their kind."""
    begun, last = False, None
    for b in batches:
        if not b.num_rows:
            continue
        ends = sorted({e for k in range(upto) for e in pc.run_end_encode(b.column(k)).run_ends.to_pylist()} | set(range(PIECE, b.num_rows, PIECE)))
        for at, end in zip([0, *ends], ends):
            mark = [b.column(k)[at].as_py() for k in range(upto)]
            yield not begun or mark != last, b.slice(at, end - at)
            begun, last = True, mark


def pack_runs(items: DataFrame, key: str, order: str, size: str, limit: int, batch: str = "batch") -> DataFrame:
    """items (key, order, size; other columns go) with the number of their run of the key, from 0.

    `order` is unique in a key.  A null size counts as 0; a null key is a key.  The
    sorted items are written to the shared folder, for the borders of the stretches
    must stay what they are.
    """
    spark = items.sparkSession
    at = shared_folder(spark, "runs")
    sorted_items = items.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))
    sorted_items = sorted_items.repartitionByRange("key", "ord").withColumn("part", F.spark_partition_id())
    sorted_items.write.parquet(at)
    stored = spark.read.schema(sorted_items.schema).parquet(at)
    placed = stored.select("part", "key", "ord", "size").repartition("part").sortWithinPartitions("part", "key", "ord")

    kinds = [placed.schema["part"], placed.schema["key"]]
    schema = StructType([*kinds, *StructType.fromDDL(SUMMARY).fields])
    arrow = to_arrow_schema(schema)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(mark: list, found: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([*mark, *found], arrow)], schema=arrow)

        mark, found = [], None
        for new, b in _pieces(batches, 2):
            own = summary(b.column("size").to_numpy(), limit)
            if new and found is not None:
                yield row(mark, found)
            mark, found = ([b.column(0)[0].as_py(), b.column(1)[0].as_py()], own) if new else (mark, together(found, own))
        if found is not None:
            yield row(mark, found)

    carried = StructType([*kinds, *StructType.fromDDL("carry bigint, first bigint").fields])
    carried_arrow = to_arrow_schema(carried)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, carry, runs = None, False, None, 0
        for b in batches:
            carries, firsts = [], []
            reaches, leaves, counts, totals = (b.column(k) for k in (4, 5, 6, 3))
            for i, k in enumerate(b.column(1).to_pylist()):
                if not begun or k != current:
                    current, begun, carry, runs = k, True, None, 0
                carries.append(carry)
                firsts.append(max(runs - 1, 0))
                reach = np.array(reaches[i].as_py(), np.int64)
                which = 0 if carry is None else int(np.searchsorted(-reach, -carry, "right"))
                if which < len(reach):
                    carry, runs = leaves[i][which].as_py(), runs + counts[i][which].as_py()
                else:
                    carry += totals[i].as_py()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(carries, pa.int64()), pa.array(firsts, pa.int64())], schema=carried_arrow)

    sums = placed.mapInArrow(sum_up, schema)
    carries = sums.repartition("key").sortWithinPartitions("key", "part").mapInArrow(follow, carried)
    named = carries.select(F.col("part").alias("p"), F.col("key").alias("k"), "carry", "first")
    joined = stored.join(named, (F.col("part") == F.col("p")) & F.col("key").eqNullSafe(F.col("k"))).select("part", "key", "ord", "size", "carry", "first")
    joined = joined.repartition("part").sortWithinPartitions("part", "key", "ord")
    out = StructType([placed.schema["key"], placed.schema["ord"], placed.schema["size"], *StructType.fromDDL("batch bigint").fields])
    out_arrow = to_arrow_schema(out)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, first = None, 0
        for new, b in _pieces(batches, 2):
            if new:
                carry, first = b.column("carry")[0].as_py(), b.column("first")[0].as_py()
            found, carry = number_on(b.column("size").to_numpy(), carry, limit)
            t = pa.Table.from_arrays([*(b.column(c) for c in ("key", "ord", "size")), pa.array(found + first)], names=out_arrow.names)
            first += int(found[-1])
            yield from t.cast(out_arrow).to_batches()

    return joined.mapInArrow(assign, out).toDF(key, order, size, batch)

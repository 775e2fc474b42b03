"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

Rows belong to virtual partitions by a hash of their identity, which does not
depend on how the table is laid out.  The counts of rows that each partition sends
to each shard are drawn exactly: for a uniform shuffle they follow a multivariate
hypergeometric law, whose margins are the partition counts and the shard sizes.
Rows are then permuted inside their partition (by a keyed hash), the first go to
shard 0 and so on by the drawn counts, and are permuted again inside the shard.

The matrix is drawn in two steps, which gives the same law: the driver draws the
counts of GROUPS ranges of partitions, and a task per range draws those of its
partitions, with a seed of its own.  Nothing that reaches the driver or is broadcast
grows beyond GROUPS rows, and HOT_PARTITIONS for rows that repeat very often.

Inputs and edge cases
* null text: size 1, crc32 of the empty string.  Null doc_id: placed by the hash of
  size and crc32, and returned as null.
* repeated rows are placed one by one; rows equal in id and text are exchangeable.
  Partitions that repeated rows overfill are parted by the rows' place in the input.
* an empty table gives no rows; fewer rows than shards leave the last shards empty.
* other input columns travel in a struct and cannot clash.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, scratch, utf8_size

SHARDS = 8
SEED = 20250
PARTITION_ROWS = 8192
GROUPS = 1024
#: Overfilled partitions up to which their list is broadcast.
HOT_PARTITIONS = 100_000


def draw_hypergeometric(rng: random.Random, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement from good + bad are good.

    Exact up to the rounding of log-gamma: about 1e-3 of the mass at 10**11.  Rejection for discrete log-concave laws: a flat middle and exponential tails
    around the mode cover the law, whose mass is evaluated by log-gamma.
    """
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low

    def log_mass(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    mode = min(max((sample + 1) * (good + 1) // (good + bad + 2), low), high)
    total = math.lgamma(good + bad + 1) - math.lgamma(sample + 1) - math.lgamma(good + bad - sample + 1)
    scale = math.lgamma(good + 1) + math.lgamma(bad + 1) - total
    peak = math.exp(log_mass(mode) + scale)
    width = 1 + peak / 2
    while True:
        u, w = rng.random(), 1 - rng.random()
        if u <= width / (1 + width):
            y = rng.random() * width / peak
            bound = 1.0
        else:
            y = (width + rng.expovariate(1)) / peak
            bound = math.exp(width - peak * y)
        k = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if low <= k <= high and math.log(w * bound) <= log_mass(k) - log_mass(mode):
            return k


def communication_matrix(counts: list[int], shards: list[int], seed: int = SEED) -> list[list[int]]:
    """Rows each partition sends to each shard: a draw of the matrix with these margins."""
    rng = random.Random(seed)
    left = list(shards)
    matrix = []
    for n in counts:
        row, pool = [], sum(left)
        for s, room in enumerate(left):
            k = n if s == len(left) - 1 else draw_hypergeometric(rng, room, pool - room, n)
            row.append(k)
            pool -= room
            n -= k
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(docs: DataFrame, identity: list[Column], n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs as struct `doc`, with shard (0..n_shards-1, sizes at most one apart) and slot (gapless from 0).

    `identity` are the columns that tell rows apart; they seed both permutations.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_sharded(docs, identity, n_shards, seed), "slots")


def _sharded(docs: DataFrame, identity: list[Column], n_shards: int, seed: int) -> DataFrame:
    n_rows = docs.count()
    n_parts = max(1, -(-n_rows // PARTITION_ROWS))
    keyed = durable(docs.select(*[F.xxhash64(F.lit(seed + k), *identity).alias(f"key{k}") for k in range(3)], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), "keyed")
    whole = keyed.withColumn("part", F.pmod("key0", F.lit(n_parts))).withColumn("sub", F.lit(0))
    overfull = durable(whole.groupBy("part").count().filter(F.col("count") > 4 * PARTITION_ROWS), "overfull")
    n_hot = overfull.count()
    if n_hot:
        # rows that repeat too often also go by their place in the stored table, which does not change
        hot = overfull.select(F.col("part").alias("hot"), F.ceil(F.col("count") / PARTITION_ROWS).alias("pieces"))
        salted = keyed.withColumn("part", F.pmod("key0", F.lit(n_parts))).withColumn("place", F.xxhash64(F.monotonically_increasing_id()))
        met = salted.join(F.broadcast(hot) if n_hot <= HOT_PARTITIONS else hot, F.col("part") == F.col("hot"), "left")
        key = lambda k: F.when(F.col("hot").isNull(), F.col(f"key{k}")).otherwise(F.xxhash64(f"key{k}", "place")).alias(f"key{k}")
        whole = met.select("part", F.coalesce(F.pmod("place", F.col("pieces")), F.lit(0)).cast("int").alias("sub"), "key0", key(1), key(2), "doc")
    placed = durable(whole, "placed")
    counts = durable(placed.groupBy("part", "sub").count().withColumn("grp", F.floor(F.col("part") * GROUPS / n_parts).cast("int")), "part-counts")
    sizes = [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]
    in_group = {r["grp"]: r["n"] for r in counts.groupBy("grp").agg(F.sum("count").alias("n")).collect()}
    groups = sorted(in_group)
    margins = dict(zip(groups, communication_matrix([in_group[g] for g in groups], sizes, seed)))

    def draw(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["part", "sub"])
        g = int(part["grp"].iloc[0])
        matrix = communication_matrix(part["count"].tolist(), margins[g], seed * GROUPS + g + 1)
        return pd.DataFrame({"part": part["part"], "sub": part["sub"], "ends": [[sum(row[: s + 1]) for s in range(n_shards)] for row in matrix]})

    sent = counts.groupBy("grp").applyInPandas(draw, "part bigint, sub int, ends array<bigint>")
    turn = F.row_number().over(Window.partitionBy("part", "sub").orderBy("key1", "key2")).cast("long")
    sharded = placed.withColumn("turn", turn).join(sent, ["part", "sub"]).withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("turn"))))
    bits = max(0, math.ceil(math.log2(max(1, n_rows / n_shards / PARTITION_ROWS))))
    # the high bits of the second key, as an unsigned number, order the buckets of a shard
    bucket = F.shiftrightunsigned("key2", 64 - bits) if bits else F.lit(0).cast("long")
    sharded = durable(sharded.select("doc", "shard", "key2", "key1", bucket.alias("bucket")), "sharded")
    tally = sharded.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ahead = tally.withColumn("ahead", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("key2", "key1"))
    return sharded.withColumn("inside", inside).join(ahead, ["shard", "bucket"]).select("doc", "shard", (F.col("ahead") + F.col("inside") - 1).alias("slot"))


def op6_query(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "utf-8"))
    rows = docs.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), crc.alias("text_crc32"))
    placed = shuffle_into_shards(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select("doc.doc_id", "doc.size", "doc.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SIZES_ORACLE = """
with n as (select count(*) n from documents), s as (select unnest(range(0, 8)) shard),
sized as (select shard, n // 8 + (shard < n % 8)::bigint n_rows from s, n)
select shard, n_rows, n_rows n_slots, 0::bigint first_slot, n_rows - 1 last_slot from sized where n_rows > 0
"""

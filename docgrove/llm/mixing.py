"""Mixing sources to target weights by weighted fair queueing.

Each document, in a shuffled order per source, gets a virtual finish time: the
source's cumulative words up to and with it, divided by the source's target.
Ordering all copies by that time interleaves the sources in proportion; the order
is cut where the total budget is used up.  A source whose target exceeds its size
is queued again, up to ``repeats`` times.

Within a source, finish times rise with (shuffle key, size).  So the cut is, for
each copy of a source, one place in that order, and a document's copies follow from
comparing its key with its source's places: texts are never shuffled.  The places
are found on a narrow table (shuffle key, source, size), stored once:

* sums per (source, bucket of the shuffle key) give each bucket's span of finish
  times.  Targets add up to the budget, so all that ends before time 1 is taken;
* only buckets that reach into the short time behind are range-sorted row by row, by
  finish time, up to the row that no longer fits.  That time shrinks with the corpus:
  it holds about one longest document per source.

The table of sources is taken as configuration-sized: one row per source goes
through one task to rank them and to level the targets.

Inputs and edge cases
* null text has size 0; sizes of 0 are taken 0 words.  Null source is a source of
  its own, ordered last.
* null doc_id is kept; its place in the shuffle comes from ``nameless`` (the text's
  digest in the query and the pipeline).
* repeated rows of one id and size are queued one after another, by partition of the
  input.  Where the cut falls among them, exactly as many are taken as fit; which of
  them depends on the partitions, the rows (doc_id, size, taken) do not.
* an empty table, or one without words, gives targets of 0 and an empty mix.
* added columns get names that the table does not have.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, scratch, unused_name, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"
#: Rows that a bucket of the shuffle key should hold.
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, source_rank, target): shares of all words by weight, none above repeats x its size.

    Sources are sorted by how soon they fill up (capacity over weight).  With the
    first k full, the rest share what is left at one level; the first k at which
    the next source stays below its capacity gives that level.
    """
    all_rows = Window.orderBy(F.lit(0))
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_rank"), F.lit(len(weights))) + 1)
    capped = ranked.withColumn("weight", weight).withColumn("capacity", repeats * F.col("source_size"))
    by_fill = Window.orderBy((F.col("capacity") / F.col("weight")).asc(), "source_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.coalesce(F.sum("capacity").over(before), F.lit(0))).cast("double") / F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    leveled = capped.withColumn("level", level).withColumn("fill_rank", F.row_number().over(by_fill))
    holds = F.when(F.col("capacity") >= F.col("level") * F.col("weight"), F.struct("fill_rank", "level"))
    chosen = F.min(holds).over(all_rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    target = F.least(F.col("capacity").cast("double"), F.coalesce(chosen, F.lit(0.0)) * F.col("weight"))
    return leveled.select("source", "source_size", "source_rank", target.alias("target"))


def shuffle_key(id_col: str = "doc_id", nameless: Column | None = None, seed: str = SEED) -> Column:
    """Hex digest of the id and the seed; rows without an id go by `nameless`."""
    name = F.col(id_col).cast("string")
    return F.md5(F.concat_ws(":", name if nameless is None else F.coalesce(name, nameless), F.lit(seed)))


def sized(docs: DataFrame, size: Column, source_col: str = "source", key: Column | None = None) -> DataFrame:
    """The narrow table: every row's doc_id, source, size and shuffle key."""
    key = shuffle_key() if key is None else key
    return docs.select(F.col("doc_id"), F.col(source_col).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"), key.alias("shuffle_key"))


@dataclass(frozen=True)
class Place:
    """Where a copy of a source ends: in order (key, size), with `taken` of the `among` equal rows there."""

    key: str
    size: int
    taken: int
    among: int


@dataclass(frozen=True)
class SourceCut:
    """Every row of a source is taken `whole` times, and once more per place that it does not pass."""

    source: str | None
    source_size: int
    target: float
    whole: int
    places: list[Place]


CUTS = "cut_source string, cut struct<source_size:bigint,target:double,whole:int,places:array<struct<key:string,size:bigint,taken:bigint,among:bigint>>>"


def cuts(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[SourceCut]:
    """The cut of every source of the (stored) narrow table.

    Sums per bucket stay distributed; one row per source and copy reaches the driver.
    """
    n_rows = rows.count()
    digits = min(8, max(1, math.ceil(math.log(max(1, n_rows) / BUCKET_ROWS, 16))))
    bucket = F.substring("shuffle_key", 1, digits)
    sums = durable(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"), F.max("size").alias("longest")), "bucket-sums")
    sources = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size"), F.max("longest").alias("longest"))
    targets = durable(source_targets(sources.select("source", "source_size"), weights, repeats).join(sources.select(F.col("source").alias("s"), "longest"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    known = targets.collect()  # one row per source
    if not any(t["target"] for t in known):
        return [SourceCut(t["source"], t["source_size"], t["target"], 0, []) for t in known]
    copies = F.least(F.lit(repeats), F.greatest(F.ceil(F.col("target") / F.col("source_size")), F.lit(1))).cast("int")
    live = targets.filter("target > 0").withColumn("copies", copies)
    ahead = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    spans = sums.withColumn("ahead", ahead).select(F.col("source").alias("s"), "bucket", "bucket_size", "ahead")
    finish = lambda words, k: (words + k * F.col("source_size")).cast("double") / F.col("target")
    each = spans.join(live, F.col("s").eqNullSafe(F.col("source"))).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    each = durable(each.select("source", "source_rank", "source_size", "target", "bucket", "copy", "bucket_size", "ahead", finish(F.col("ahead"), F.col("copy")).alias("opens"), finish(F.col("ahead") + F.col("bucket_size"), F.col("copy")).alias("closes")), "bucket-spans")

    budget = sum(t["source_size"] for t in known)
    early = 1 - 1e-9  # all that ends by then is within the budget, whatever the rounding
    reach = 2 * sum(t["longest"] for t in known) / budget
    while True:
        late = early + reach
        near = each.filter((F.col("closes") > early) & (F.col("opens") <= late))
        passed = each.filter(F.col("closes") <= early).agg(F.coalesce(F.sum("bucket_size"), F.lit(0))).first()[0]
        order = ["at", "source_rank", "copy", "shuffle_key", "size"]
        # near buckets are a few per source; their rows meet by (source, bucket)
        keys = near.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "source_rank", "source_size", "target", "ahead", "copy")
        placed = rows.withColumn("bucket", bucket).join(keys.select("s", "b", "ahead").distinct(), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).select("source", "bucket", "size", "shuffle_key", "ahead")
        inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("shuffle_key", "size").rowsBetween(Window.unboundedPreceding, 0))
        placed = placed.withColumn("cumulative", F.col("ahead") + inside).drop("ahead")
        timed = durable(
            placed.join(keys.drop("ahead"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).withColumn("at", finish(F.col("cumulative"), F.col("copy"))).select("source", "source_rank", "copy", "shuffle_key", "size", "at"),
            "near-the-cut",
        )
        passed += timed.filter(F.col("at") <= early).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        behind = timed.filter((F.col("at") > early) & (F.col("at") <= late) & (F.col("size") > 0))
        running = behind.withColumn("upto", F.lit(passed) + F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        running = durable(running, "running")
        over = running.filter(F.col("upto") > budget).orderBy("upto").limit(1).first()
        if over is not None or each.filter(F.col("closes") > late).isEmpty():
            break
        reach *= 16
    taken = timed.filter((F.col("at") <= early) & (F.col("size") > 0)).select("source", "copy", "shuffle_key", "size").unionByName(running.filter(F.col("upto") <= budget).select("source", "copy", "shuffle_key", "size"))
    last = taken.groupBy("source", "copy").agg(F.max(F.struct("shuffle_key", "size")).alias("last"))
    level = F.struct("shuffle_key", "size")
    equal = lambda found: found.join(last.select(F.col("source").alias("s"), F.col("copy").alias("c"), "last"), F.col("source").eqNullSafe(F.col("s")) & (F.col("copy") == F.col("c")) & (level == F.col("last"))).groupBy("source", "copy").count()
    n_taken = {(r["source"], r["copy"]): r["count"] for r in equal(taken).collect()}
    n_among = {(r["source"], r["copy"]): r["count"] for r in equal(timed.select("source", "copy", "shuffle_key", "size")).collect()}
    ends = {(r["source"], r["copy"]): Place(r["last"]["shuffle_key"], r["last"]["size"], n_taken[r["source"], r["copy"]], n_among[r["source"], r["copy"]]) for r in last.collect()}
    # a copy without rows near the cut is taken whole if its last bucket closed, else not at all, or up to its last closed bucket
    closed = {(r["source"], r["copy"]): (r["last"], r["open"]) for r in each.groupBy("source", "copy").agg(F.max(F.when(F.col("closes") <= early, F.col("bucket"))).alias("last"), F.count_if(F.col("closes") > early).alias("open")).collect()}
    out = []
    for t in known:
        whole, places = 0, []
        for k in range(repeats):
            upto, still_open = closed.get((t["source"], k), (None, 1))
            end = ends.get((t["source"], k))
            if not still_open:
                whole += 1
            elif end is not None:
                places.append(end)
            elif upto is not None:
                places.append(Place(upto + "g", 0, 1, 1))  # behind every key of the bucket: digits are hexadecimal
        out.append(SourceCut(t["source"], t["source_size"], t["target"], whole, places))
    return out


#: Sources up to which their table of cuts, a few hundred bytes each, is broadcast.
BROADCAST_SOURCES = 10_000


def copies_taken(docs: DataFrame, found: list[SourceCut], key: Column, size: Column, source_col: str = "source") -> tuple[DataFrame, str, str]:
    """docs with the cut of their source and the number of copies taken, and the names of these two columns.

    There is one cut per source, so their join moves no row of docs.
    """
    cut, n, mark, source, split, part, turn, ahead, p, s, m = (unused_name(f"mix_{x}", docs) for x in ("cut", "copies", "key", "source", "split", "part", "turn", "ahead", "p", "s", "m"))
    rows = [(c.source, (c.source_size, c.target, c.whole, [(p.key, p.size, p.taken, p.among) for p in c.places])) for c in found]
    table = docs.sparkSession.createDataFrame(rows, CUTS).toDF(source, cut)
    table = F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table
    joined = docs.withColumn(mark, key).join(table, F.col(source_col).eqNullSafe(F.col(source)), "left").drop(source)
    before = lambda p: (F.col(mark) < p["key"]) | ((F.col(mark) == p["key"]) & (size <= p["size"]))
    taken = joined.withColumn(n, F.when(size > 0, F.col(cut)["whole"] + F.size(F.filter(F.col(cut)["places"], before))).otherwise(F.lit(0)))
    if any(p.taken < p.among for c in found for p in c.places):
        # equal rows that a cut parts
        parted = lambda p: (p["taken"] < p["among"]) & (F.col(mark) == p["key"]) & (size == p["size"])
        taken = taken.withColumn(split, F.coalesce((size > 0) & F.exists(F.col(cut)["places"], parted), F.lit(False))).withColumn(part, F.spark_partition_id())
        equal = taken.filter(split)
        # a row's turn is its number in its partition behind all rows of earlier partitions: a few counts per partition
        counts = equal.groupBy(F.col(part).alias(p), F.col(source_col).alias(s), F.col(mark).alias(m)).agg(F.count(F.lit(1)).alias(turn))
        upto = F.sum(turn).over(Window.partitionBy(s, m).orderBy(p)) - F.col(turn)
        same = (F.col(part) == F.col(p)) & F.col(source_col).eqNullSafe(F.col(s)) & (F.col(mark) == F.col(m))
        numbered = equal.withColumn(turn, F.row_number().over(Window.partitionBy(part, source_col, mark).orderBy(F.lit(0))))
        equal = numbered.join(counts.withColumn(ahead, upto).drop(turn), same).drop(p, s, m)
        over = F.filter(F.col(cut)["places"], lambda p: parted(p) & (F.col(ahead) + F.col(turn) > p["taken"]))
        equal = equal.withColumn(n, F.col(n) - F.size(over)).drop(turn, ahead)
        taken = taken.filter(~F.col(split)).unionByName(equal).drop(split, part)
    return taken.drop(mark), cut, n


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself, as rows of docs: each document as often as it is taken."""
    size, key = word_count(F.col("text")), shuffle_key(nameless=F.md5("text"), seed=seed)
    with scratch(docs.sparkSession):
        found = cuts(durable(sized(docs, size, key=key), "sizes"), weights, repeats)
    taken, cut, n = copies_taken(docs, found, key, size)
    again = unused_name("mix_again", taken)
    return taken.filter(F.col(n) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(cut, n, again)


def op2_query(docs: DataFrame) -> DataFrame:
    key = shuffle_key(nameless=F.md5("text"))
    with scratch(docs.sparkSession) as keep:
        rows = keep(sized(docs, word_count(F.col("text")), key=key), "sizes")
        found = cuts(rows)
    taken, cut, n = copies_taken(rows, found, F.col("shuffle_key"), F.col("size"))
    return taken.select("doc_id", "size", F.col(cut)["source_size"].alias("source_size"), F.col(cut)["target"].alias("target"), (F.col("size") * F.col(n)).alias("taken"))


ORACLE = r"""
with base as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size, md5(doc_id::varchar || ':mix-1') k from documents),
sources as (select source, sum(size)::bigint source_size from base group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 rnk from sources),
weighted as (select *, [5, 2, 1][(rnk % 3) + 1] weight, 3 * source_size capacity from ranked),
filled as (
  select *, row_number() over f fill_rank,
    (sum(source_size) over () - coalesce(sum(capacity) over (f rows between unbounded preceding and 1 preceding), 0))::double
      / sum(weight) over (f rows between current row and unbounded following) level
  from weighted window f as (order by capacity / weight, rnk)),
chosen as (select level from filled where capacity >= level * weight order by fill_rank limit 1),
targets as (select source, source_size, rnk, least(capacity::double, (select level from chosen) * weight) target from filled),
queued as (
  select b.doc_id, b.size, b.k, t.*, sum(b.size) over (partition by b.source order by k, b.size rows unbounded preceding) cumulative
  from base b join targets t on b.source is not distinct from t.source),
copies as (
  select doc_id, size, rnk, k, c, (cumulative + c * source_size)::double / target finish
  from queued, unnest(range(0, 3)) u(c)
  where target > 0 and size > 0 and c < greatest(ceil(target / source_size), 1)),
ordered as (select *, sum(size) over (order by finish, rnk, c, k rows unbounded preceding) upto from copies),
taken as (select doc_id, sum(size)::bigint taken from ordered where upto <= (select sum(size) from base) group by doc_id)
select q.doc_id, q.size, q.source_size, q.target, coalesce(taken, 0)::bigint taken from queued q left join taken using (doc_id)
"""

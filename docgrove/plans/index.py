"""The vector index: Parquet segments under a manifest, keyed by (namespace, id).

An upsert writes its own records as a new segment, and the keys of the older records
that they replace as a small table beside it (``gone``); no older record is written
again.  Reading leaves out what is gone.  ``compact`` writes the live records as one
segment.  Segments are partitioned by namespace and by `list`, the coarse centroid of a
record (-1 before ``fit_lists``), so a search reads the lists that it probes and no others.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sanitize_id, truncate_content
from ..functions.vectors import assert_dimension, dot
from ..model import RECORD_METADATA
from ..sources.config import dimension_mismatch
from . import lists as ivf
from . import search

CONTENT_LIMIT = 8000
#: Keys of gone records that are broadcast to a segment; more are joined by a shuffle of ids.
BROADCAST_KEYS = 1 << 20


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; ranks are limited before the shuffle and after."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def to_records(chunks: DataFrame, vector: str = "values", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, values, metadata) of embedded chunks, and `keep`: ids made safe, contents cut, the description left out."""
    flat = {k: F.col(f"metadata.{k}") for k in ("sourceUrl", "repository", "language", "method", "path", "version")}
    flat |= {k: F.col(k) for k in ("documentPath", "documentTitle", "category", "heading")} | {"content": truncate_content(F.col("content"), CONTENT_LIMIT)}
    return chunks.select(sanitize_id(F.col("id")).alias("id"), F.col(vector).cast("array<float>").alias("values"), F.struct(*[flat[k].alias(k) for k in RECORD_METADATA]).alias("metadata"), *keep)


METADATA = "struct<" + ",".join(f"{k}:string" for k in RECORD_METADATA) + ">"
#: Columns of a record as read, and as stored.
RECORD = f"id string, values array<float>, metadata {METADATA}, source string, namespace string"
STORED = f"id string, values array<float>, metadata {METADATA}, source string, file string, norm double, namespace string, list int"
KEY = ["namespace", "id"]


@dataclass
class Segment:
    """Records written at once, and the tables of keys that are gone from them since (name, rows)."""

    data: str
    records: int
    gone: list[tuple[str, int]] = field(default_factory=list)


@dataclass
class Manifest:
    """What a version of the index consists of."""

    number: int = -1
    segments: list[Segment] = field(default_factory=list)
    centroids: str | None = None
    probes: int = 0

    def text(self) -> str:
        return json.dumps({"segments": [[s.data, s.records, s.gone] for s in self.segments], "centroids": self.centroids, "probes": self.probes})

    @classmethod
    def of(cls, number: int, text: str) -> Manifest:
        x = json.loads(text)
        return cls(number, [Segment(d, n, [tuple(g) for g in gone]) for d, n, gone in x["segments"]], x["centroids"], x["probes"])

    def files(self) -> set[str]:
        """Folders that the version reads."""
        data = {f"data/{s.data}" for s in self.segments} | {f"gone/{g}" for s in self.segments for g, _ in s.gone}
        return data | ({f"centroids/{self.centroids}"} if self.centroids else set())


class Store:
    """Small files of a folder on any store that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at, store = self._at(folder)
        return sorted(f.getPath().getName() for f in store.listStatus(at)) if store.exists(at) else []

    def read(self, name: str) -> str | None:
        at, store = self._at(name)
        if not store.exists(at):
            return None
        stream = store.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        at, store = self._at(name)
        store.delete(at, True)

    def put_new(self, name: str, text: str) -> bool:
        """Writes a file whole if there is none of its name, else changes nothing; of two writers one succeeds.

        The text is written under another name and then given this one, by a hard link on
        a local disk, by a rename that does not overwrite elsewhere.
        """
        at, store = self._at(name)
        own, _ = self._at(f"{name}.{uuid.uuid4().hex}")
        store.mkdirs(at.getParent())
        out = store.create(own, False)
        out.write(text.encode())
        out.close()
        try:
            if store.getScheme() == "file":
                os.link(own.toUri().getPath(), store.makeQualified(at).toUri().getPath())
            else:
                options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.spark._jsc.hadoopConfiguration()).rename(own, at, options)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            store.delete(own, False)


class VectorIndex:
    """The index under `path`.  Readers take the manifest of the greatest number.

    A version is published by creating the next manifest, which one of several writers
    does; the others look at what came between, add what that replaces, and try the next
    number.  The KEPT last versions stay for readers that have begun.
    """

    KEPT = 2
    ATTEMPTS = 50
    #: An upsert that leaves more segments, or more gone than live records, is followed by a compaction.
    MOST_SEGMENTS = 8

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str = "cosine"):
        self.spark, self.path, self.dimension, self.metric = spark, path.rstrip("/"), dimension, metric
        self.store = Store(spark, self.path)

    def remove(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def versions(self) -> list[str]:
        """Manifests, oldest first."""
        return [n for n in self.store.names("log") if n.endswith(".json")]

    def manifest(self) -> Manifest:
        there = self.versions()
        if not there:
            raise ValueError(f"no index at {self.path}")
        return Manifest.of(int(there[-1][:-5]), self.store.read(f"log/{there[-1]}"))

    def create(self) -> None:
        """Stores dimension and metric, once; an index of another shape is an error."""
        self.store.put_new("settings.json", json.dumps({"dimension": self.dimension, "metric": self.metric}))
        kept = json.loads(self.store.read("settings.json"))
        wrong = dimension_mismatch(kept["dimension"], self.dimension) or (f"the index compares by {kept['metric']}" if kept["metric"] != self.metric else None)
        if wrong:
            raise ValueError(wrong)

    # --- reading ----------------------------------------------------------------

    def _segment(self, s: Segment, namespace: str | None = None, probed: list[int] | None = None) -> DataFrame:
        """The live records of a segment, as stored."""
        found = self.spark.read.schema(STORED).parquet(f"{self.path}/data/{s.data}")
        if namespace is not None:
            found = found.filter(F.col("namespace").isNull() if namespace == "" else F.col("namespace") == namespace)
        if probed is not None:
            found = found.filter(F.col("list").isin(probed))
        # a partition without a name is read as null
        found = found.withColumn("namespace", F.coalesce("namespace", F.lit("")))
        if s.gone:
            gone = self.spark.read.schema("namespace string, id string").parquet(*(f"{self.path}/gone/{g}" for g, _ in s.gone))
            gone = F.broadcast(gone) if sum(n for _, n in s.gone) <= BROADCAST_KEYS else gone
            found = found.join(gone, KEY, "left_anti")
        return found

    def _live(self, m: Manifest, namespace: str | None = None, probed: list[int] | None = None) -> DataFrame:
        found = self.spark.createDataFrame([], STORED)
        for s in m.segments:
            found = found.unionByName(self._segment(s, namespace, probed))
        return found

    def read(self, namespace: str | None = None) -> DataFrame:
        return self._live(self.manifest(), namespace).select("id", "values", "metadata", "source", "namespace")

    def stats(self) -> dict[str, int]:
        """Counted from the manifest; nothing is scanned."""
        kept = json.loads(self.store.read("settings.json") or "{}")
        m = self.manifest()
        return {"vectorCount": sum(s.records - sum(n for _, n in s.gone) for s in m.segments), "dimension": kept.get("dimension", self.dimension)}

    # --- writing ----------------------------------------------------------------

    def _model(self, m: Manifest):
        return ivf.load(f"{self.path}/centroids/{m.centroids}") if m.centroids else None

    def _write(self, records: DataFrame, m: Manifest) -> tuple[Segment, DataFrame]:
        """Stores records (id, values, metadata, source, namespace and others) as a segment; it is part of no version yet."""
        name = uuid.uuid4().hex
        rows = ivf.assign(records.withColumn("norm", F.sqrt(dot("values", "values"))), self._model(m), "values")
        # a list's records to few files
        rows = rows.repartition("namespace", "list") if m.centroids else rows
        rows.write.partitionBy("namespace", "list").parquet(f"{self.path}/data/{name}")
        stored = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}")
        return Segment(name, stored.count()), stored

    def _gone(self, s: Segment, keys: DataFrame, sources: list[str], namespace: str, files: DataFrame | None) -> Segment:
        """The segment less its records with new keys or of dropped sources; their keys are written, and nothing else."""
        old = self._segment(s, namespace).select("namespace", "id", "source", "file")
        # records of sources that are dropped go whatever their ids; the others meet the new ids
        dropped = F.coalesce(F.col("source").isin(sources), F.lit(False)) if sources else F.lit(False)
        rest = old.filter(~dropped)
        hit = old.filter(dropped).unionByName(rest.join(keys, "id", "left_semi"))
        if files is not None:
            hit = hit.unionByName(rest.join(keys, "id", "left_anti").join(files, ["source", "file"], "left_semi").select(rest.columns))
        name = uuid.uuid4().hex
        at = f"{self.path}/gone/{name}"
        hit.select(*KEY).write.parquet(at)
        n = self.spark.read.schema("namespace string, id string").parquet(at).count()
        if not n:
            self.store.remove(f"gone/{name}")
            return s
        return Segment(s.data, s.records, [*s.gone, (name, n)])

    def _put(self, m: Manifest) -> bool:
        if not self.store.put_new(f"log/{m.number:012d}.json", m.text()):
            return False
        kept = self.versions()
        old, kept = kept[: -self.KEPT], kept[-self.KEPT :]
        texts = {n: self.store.read(f"log/{n}") for n in [*old, *kept]}
        # other writers may be removing the same versions
        files = {n: Manifest.of(0, t).files() for n, t in texts.items() if t is not None}
        for name in set().union(*(files[n] for n in old if n in files)) - set().union(*(files[n] for n in kept if n in files)):
            self.store.remove(name)
        for n in old:
            self.store.remove(f"log/{n}")
        return True

    def _now(self) -> Manifest:
        return self.manifest() if self.versions() else Manifest()

    def upsert(self, records: DataFrame, source: str = "", namespace: str = "", replace_source: bool = False) -> None:
        """Adds records (id, values, metadata); with replace_source, the source's old ones go."""
        self.replace(records.withColumn("source", F.lit(source)), [source] if replace_source else [], namespace)

    def replace(self, records: DataFrame, sources: list[str], namespace: str = "", files: DataFrame | None = None) -> None:
        """Adds records (id, values, metadata, source), of one id one and instead of an old one; old ones of `sources` go.

        So do old ones of the `files` (source, file); records may say their `file`.

        Of records with one id the last by `source_ord` stays, if there is such a column
        (the later source in the configuration, and in a source the later file and chunk).
        """
        self.create()
        base = self._now()
        order = F.col("source_ord") if "source_ord" in records.columns else F.lit(0)
        fresh = records.select("id", assert_dimension("values", self.dimension).alias("values"), "metadata", "source", (F.col("file") if "file" in records.columns else F.lit(None)).cast("string").alias("file"), F.lit(namespace).alias("namespace"), order.alias("ord"))
        segment, stored = self._write(fresh, base)
        twice = stored.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
        if not twice.isEmpty():
            doubled = segment
            rank = stored.withColumn("ord", F.struct("ord", F.xxhash64("metadata", "values").alias("h")))
            single = rank.join(twice, "id", "left_anti").unionByName(keep_last(rank.join(twice, "id", "left_semi"), "id", "ord"))
            segment, stored = self._write(single.withColumn("namespace", F.lit(namespace)).drop("ord", "norm", "list"), base)
            self.store.remove(f"data/{doubled.data}")
        self._publish(segment, stored, base.centroids, sources, namespace, files)

    def _publish(self, segment: Segment, records: DataFrame, centroids: str | None, sources: list[str], namespace: str, files: DataFrame | None) -> None:
        done: dict[str, tuple[list, Segment]] = {}
        keys = records.select("id")
        for attempt in range(self.ATTEMPTS):
            m = self._now()
            if m.centroids != centroids:
                # the lists have been fitted anew meanwhile
                moved = segment
                segment, records = self._write(records.withColumn("namespace", F.lit(namespace)).drop("norm", "list"), m)
                keys, centroids = records.select("id"), m.centroids
                self.store.remove(f"data/{moved.data}")
            try:
                for s in m.segments:
                    # what other writers have changed since the last attempt is looked at again
                    if s.data not in done or done[s.data][0] != s.gone:
                        done[s.data] = (s.gone, self._gone(s, keys, sources, namespace, files))
            except Exception:
                if self._now().number == m.number:
                    raise
                continue  # the version went while it was read
            older = [done[s.data][1] for s in m.segments]
            segments = [s for s in older if s.records > sum(n for _, n in s.gone)] + [segment] * (segment.records > 0)
            if self._put(Manifest(m.number + 1, segments, m.centroids, m.probes)):
                gone = sum(n for s in segments for _, n in s.gone)
                if len(segments) > self.MOST_SEGMENTS or 2 * gone > sum(s.records for s in segments):
                    self.compact()
                return
            time.sleep(0.01 * attempt)
        raise RuntimeError(f"{self.ATTEMPTS} other versions came first")

    def compact(self) -> bool:
        """Writes the live records as one segment; whether it was published.  What other writers delete meanwhile is gone from it too."""
        base = self.manifest()
        return self._rewrite(base, base.centroids, base.probes)

    def _rewrite(self, base: Manifest, centroids: str | None, probes: int) -> bool:
        whole, _ = self._write(self._live(base).drop("norm", "list"), Manifest(centroids=centroids))
        known = {s.data: s.gone for s in base.segments}
        for attempt in range(self.ATTEMPTS):
            m = self._now()
            if set(known) - {s.data for s in m.segments} or centroids != m.centroids and set(known) != {s.data for s in m.segments}:
                # another compaction, an upsert that left nothing of a segment, or one into other lists came first
                self.store.remove(f"data/{whole.data}")
                return False
            later = [g for s in m.segments for g in s.gone if s.data in known and g not in known[s.data]]
            segments = [Segment(whole.data, whole.records, later)] * (whole.records > 0) + [s for s in m.segments if s.data not in known]
            if self._put(Manifest(m.number + 1, segments, centroids, probes)):
                return True
            time.sleep(0.01 * attempt)
        raise RuntimeError(f"{self.ATTEMPTS} other versions came first")

    def clear(self) -> None:
        self.create()
        while not self._put(Manifest(self._now().number + 1)):
            pass

    # --- inverted lists -----------------------------------------------------------

    def fit_lists(self, n_lists: int | None = None, recall: float = 0.95, k: int = 10, sample_rows: int = ivf.SAMPLE_ROWS) -> int:
        """Fits centroids on a sample, moves every record to its list, and gives the probes that reach `recall` at k."""
        while True:
            base = self.manifest()
            live = self._live(base)
            n = sum(s.records - sum(g for _, g in s.gone) for s in base.segments)
            model = ivf.fit(live, n, n_lists, "values", sample_rows)
            name = uuid.uuid4().hex
            model.write().save(f"{self.path}/centroids/{name}")
            probes = ivf.tune(ivf.assign(live.drop("list"), model, "values"), model, n, recall, k)
            if self._rewrite(base, name, probes):
                return probes
            self.store.remove(f"centroids/{name}")

    def candidates(self, query: list[float], namespace: str | None = None, probes: int | None = None) -> DataFrame:
        """The records of the lists nearest to the query, with `norm`; all of them where there are no lists, or with 0 probes."""
        m = self.manifest()
        probes = m.probes if probes is None else probes
        probed = None
        if m.centroids and probes:
            probed = [*ivf.order(self._model(m), np.array([query], float))[0][:probes].tolist(), ivf.UNLISTED]
        return self._live(m, namespace, probed).select("id", "values", "metadata", "source", "namespace", "norm")

    def top_k_each(self, queries: DataFrame, k: int, namespace: str | None = None, probes: int | None = None) -> DataFrame:
        """The k nearest records (id, score, rank) for each row of queries (query_id, query), from the lists that each probes.

        Queries meet the records of the lists that they probe; with 0 probes every record is scored.
        """
        m = self.manifest()
        probes = m.probes if probes is None else probes
        live = self._live(m, namespace).select("id", "values", "list")
        if not (m.centroids and probes):
            return search.top_k_each(live, queries, k).select("query_id", "id", "score", "rank")
        asked = queries.withColumn("list", F.explode(ivf.probed(self._model(m), F.col("query"), probes)))
        found = search.top_k_each(live, asked, k, on="list", per_query=probes + 1)
        return found.select("query_id", "id", "score", "rank")

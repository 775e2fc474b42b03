"""READMEs, migration guides and changelogs to chunks on DataFrames.

The rules are those of ``chunking.readme_chunks``, ``migration_chunks`` and ``changelog_chunks``, stated as
relations instead of a walk over one document:

* a section larger than the largest size that has children is opened; as sizes only grow
  towards the root, all that is above it is opened too.  So the sections that the walk
  visits are the roots and the children of opened sections, and of two sections neither
  needs to know more than its own parent;
* any other section belongs to the last visited one before it, which gives that one's text;
* small neighbours under one opened section are packed by ``runs.pack_runs``;
* a piece that is too large is packed by its fences, inside its row.

The rules work on sections without their texts, and no task holds those of a whole document; they are
written to the shared folder, for several later steps read them.  A text is cut and put together in the
partition of its own row, which is the only one that is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..model import ChunkConfig
from ..plans.scratch import stored
from .outline import LEVELS, SEGMENT, _with, body_of, cut_at_headings, nested, text_sections
from .runs import pack_runs


#: Names of a document's key and text inside, where no caller's column is called so.
DOC, TEXT = "_doc", "_text"


def _inner(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias(DOC), F.col(text_col).alias(TEXT), "context", "url", "language")


def _carried(rows: DataFrame, id_col: str, value: Column, name: str) -> DataFrame:
    """rows (id, section_id) with the last value that is not null at or before each, by scans in two levels."""
    rows = rows.withColumns({name: value, "seg": F.floor(F.col("section_id") / SEGMENT)})
    earlier = Window.partitionBy(id_col).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(id_col, "seg").agg(F.max_by(name, F.when(F.col(name).isNotNull(), F.col("section_id"))).alias("of_seg"))
    sums = sums.select(id_col, "seg", F.last("of_seg", ignorenulls=True).over(earlier).alias("carry"))
    upto = Window.partitionBy(id_col, "seg").orderBy("section_id").rowsBetween(Window.unboundedPreceding, 0)
    return _with(rows, sums, id_col, "seg").withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(upto), F.col("carry"))).drop("carry", "seg")


def _crumbs(opened: DataFrame, id_col: str) -> DataFrame:
    """(id, opened, crumb): for each opened section the heading of itself or the nearest section above that may be a crumb."""
    name = F.when((F.length("heading") > 3) & ~F.col("heading").isin("Introduction", "Documentation"), F.col("heading"))
    held = opened.select(id_col, F.col("section_id").alias("opened"), F.col("parent_id").alias("up"), name.alias("crumb"))
    above = held.select(id_col, F.col("opened").alias("up"), F.col("up").alias("next"), F.col("crumb").alias("theirs"))
    for _ in LEVELS[1:]:
        held = _with(held, above, id_col, "up").select(id_col, "opened", F.when(F.col("crumb").isNull(), F.col("next")).alias("up"), F.coalesce("crumb", "theirs").alias("crumb"))
    return held.select(id_col, "opened", "crumb")


def _plan(docs: DataFrame, id_col: str, config: ChunkConfig, keep_all: bool) -> DataFrame:
    """(id, pos, section_id, unit, piece, bare, title, heading, crumb) of the sections of each text (id, text), without their texts.

    `unit` is the visited section that a section belongs to, `piece` the first unit of its
    piece, null where it is left out; heading and crumb of a piece stand at its first section.
    """
    tree = stored(nested(text_sections(docs, id_col, "text").drop("content"), id_col).drop("seg", "ahead", "base", "whole"), "sections")
    parents = tree.filter("parent_id is not null").select(id_col, F.col("parent_id").alias("section_id")).distinct().withColumn("has_kids", F.lit(True))
    tree = _with(tree, parents, id_col, "section_id").withColumn("has_kids", F.coalesce("has_kids", F.lit(False)))
    tree = tree.withColumn("opens", F.col("has_kids") & (F.col("subtree_size") > config.max_size))
    opened = tree.filter("opens")
    # where nothing is opened, the roots are all that is visited
    none_opens = tree.filter(F.col("subtree_size") > config.max_size).isEmpty() or opened.isEmpty()
    if none_opens:
        tree = tree.withColumn("visited", F.col("parent_id").isNull())
    else:
        marks = opened.select(id_col, F.col("section_id").alias("parent_id")).withColumn("under", F.lit(True))
        tree = _with(tree, marks, id_col, "parent_id").withColumn("visited", F.col("parent_id").isNull() | F.coalesce("under", F.lit(False)))

    # what a section adds to the text of the one it belongs to: its text, or its title too
    alone = (F.col("own") >= config.min_size) & ~F.col("has_kids")
    level = F.least(F.greatest("level", F.lit(1)), F.lit(4))
    title = F.when((F.col("heading") != "") & (F.col("heading") != "Introduction"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), "heading"))
    bare = F.col("visited") & (F.col("opens") | alone)
    placed = _carried(tree, id_col, F.when(F.col("visited"), F.col("section_id")), "unit")
    placed = stored(placed.withColumns({"bare": bare, "title": F.when(~bare, title)}), "placed")
    own_kept = (F.col("own") >= config.min_size / 2) | (F.lit(keep_all) & (F.col("own") > 0))
    stays = F.when(F.col("opens"), own_kept).otherwise((F.col("subtree_size") >= config.min_size) | (F.col("own") > 0) | F.col("has_kids"))

    units = placed.filter("visited")
    columns = [id_col, "unit", "piece", "parent_id", "name"]
    single = lambda rows: rows.filter(stays).withColumns({"piece": F.col("unit"), "name": F.col("heading")}).select(columns)
    found = single(units.filter("parent_id is null"))
    if none_opens:
        found = found.withColumn("crumb", F.lit(None).cast("string"))
    else:
        below = units.filter("parent_id is not null").withColumn("small", F.col("subtree_size") < config.min_size)
        key = F.to_json(F.struct(F.col(id_col).alias("d"), F.col("parent_id").alias("p")))
        sizes = below.select(key.alias("key"), "section_id", F.when(F.col("small"), F.col("subtree_size")).otherwise(config.ideal_size + 1).alias("size"))
        packed = pack_runs(sizes, "key", "section_id", "size", config.ideal_size).select("key", "section_id", "batch")
        below = _with(below.withColumn("key", key), packed, "key", "section_id")
        runs = below.filter("small").groupBy(id_col, "parent_id", "batch").agg(F.array_sort(F.collect_list(F.struct("unit", "heading"))).alias("of"))
        headings = F.transform("of", lambda x: x["heading"])
        named = F.array_join(F.filter(headings, lambda h: h != ""), " / ")
        name = F.when(F.size("of") == 1, F.get(headings, 0)).when(named == "", F.lit("Combined Section")).otherwise(named)
        runs = runs.select(id_col, "parent_id", F.get("of", 0)["unit"].alias("piece"), name.alias("name"), F.explode(F.transform("of", lambda x: x["unit"])).alias("unit"))
        found = found.unionByName(single(below.filter(~F.col("small")))).unionByName(runs.select(columns))
        crumbs = _crumbs(opened, id_col).withColumnRenamed("opened", "parent_id")
        found = _with(found, crumbs, id_col, "parent_id")
    first = F.col("section_id") == F.col("piece")
    plan = _with(placed.select(id_col, "pos", "section_id", "unit", "bare", "title"), found.select(id_col, "unit", "piece", "name", "crumb"), id_col, "unit")
    return plan.select(id_col, "pos", "section_id", "unit", "piece", "bare", "title", F.when(first, F.col("name")).alias("heading"), F.when(first, F.col("crumb")).alias("crumb"))


def pieces(docs: DataFrame, id_col: str, text_col: str, config: ChunkConfig = ChunkConfig(), keep_all: bool = False) -> DataFrame:
    """(key, about, section_id, heading, crumb, content) of the pieces of each text, in the order of section_id.

    `id_col` tells the rows of docs apart; `key` is a struct of it, and `about` one of the
    other columns.  Which section belongs to which piece is found without the texts; these
    are shuffled once, to meet their plans, and cut and put together where they are.
    """
    text = tx.normalize_line_endings(F.coalesce(text_col, F.lit("")))
    plan = _plan(docs.select(F.col(id_col), text.alias("text")), id_col, config, keep_all)
    # a struct is never null, so the join's keys are its own and later groups need no shuffle
    key = F.struct(id_col).alias("key")
    entry = F.struct("section_id", "pos", "unit", "piece", "bare", "title", "heading", "crumb")
    plan = plan.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("plan"))
    texts = docs.select(key, F.struct(*(c for c in docs.columns if c not in (id_col, text_col))).alias("about"), text.alias("text")).repartition("key")
    rows = texts.join(plan, "key")
    rows = rows.withColumn("part", F.slice(cut_at_headings(F.col("text")), F.get("plan", 0)["pos"] + 1, F.size("plan")))
    rows = rows.select("key", "about", F.explode(F.arrays_zip("part", "plan")).alias("x")).select("key", "about", body_of(F.col("x.part")).alias("own"), "x.plan.*").filter("piece is not null")
    part = F.when(F.col("bare"), F.col("own")).otherwise(F.concat_ws("\n\n", "title", F.when(F.col("own") != "", F.col("own"))))
    joined = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(order, "part")))), lambda x: x["part"]), "\n\n")
    kept = [F.first("about").alias("about"), F.max("heading").alias("heading"), F.max("crumb").alias("crumb")]
    units = rows.withColumn("part", part).groupBy("key", "piece", "unit").agg(*kept, joined("section_id", F.col("part") != "").alias("part"))
    found = units.groupBy("key", "piece").agg(*kept, joined("unit", F.lit(True)).alias("content"))
    return found.select("key", "about", F.col("piece").alias("section_id"), "heading", "crumb", "content")


def _cut_at_fences(content: Column, limit: int, least: float) -> Column:
    """(done, held): prose and fences packed to strings of the limit at most, those under the least size left out, and what is packed last."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    kept = lambda s: F.when(F.length(tx.js_trim(s["held"])) >= least, F.array_append(s["done"], tx.js_trim(s["held"]))).otherwise(s["done"])
    step = lambda s, p: F.when(F.length(s["held"]) + F.length(p) <= limit, F.struct(s["done"].alias("done"), F.concat(s["held"], p).alias("held"))).otherwise(F.struct(kept(s).alias("done"), p.alias("held")))
    return F.aggregate(tx.split_fences(content), state, step, lambda s: F.struct(s["done"].alias("done"), tx.js_trim(s["held"]).alias("held")))


def _with_tail(cut: Column, least: float) -> Column:
    return F.when(F.length(cut["held"]) >= least, F.array_append(cut["done"], cut["held"])).otherwise(cut["done"])


def packed_by_fences(content: Column, config: ChunkConfig) -> Column:
    """The parts of a piece, at fences, in strings of the largest size at most; too small ones go, and a piece without others stays whole."""
    cut = _with_tail(_cut_at_fences(content, config.max_size, config.min_size), config.min_size / 2)
    return F.when(F.length(content) <= config.max_size, F.array(content)).otherwise(F.when(F.size(cut) > 0, cut).otherwise(F.array(content)))


def section_chunks(docs: DataFrame, id_col: str = "id", text_col: str = "content", config: ChunkConfig = ChunkConfig(), migration: bool = False, keep_all: bool = False) -> DataFrame:
    """CHUNKS of docs (id, context, content, url, language) with id_col and `index`, by README or migration rules."""
    rules = ChunkConfig(config.max_size, 100, config.ideal_size) if migration else config
    names = {"id": "chunk_id"} if id_col == "id" else {}
    docs, outer, id_col, text_col = _inner(docs, id_col, text_col), id_col, DOC, TEXT
    found = pieces(docs, id_col, text_col, rules, keep_all)
    parts = F.array("content") if migration else packed_by_fences(F.col("content"), config)
    found = found.select("key", "about", "section_id", "heading", "crumb", F.posexplode(parts).alias("piece", "content")).filter(F.length("content") >= (100 if migration else config.min_size / 2))
    index = F.row_number().over(Window.partitionBy("key").orderBy("section_id", "piece")) - 1
    found = found.withColumn("index", index.cast("bigint")).select("key.*", "about.*", "index", "heading", "crumb", "piece", "content")
    kind, file, category = ("migration", "MIGRATION.md", "migration") if migration else ("readme", "README.md", "documentation")
    context, say = F.coalesce("context", F.lit("")), F.concat
    heading = say("heading", F.when(F.col("piece") > 0, F.lit(" (continued)")).otherwise(F.lit("")))
    url = F.col("url") if migration else F.coalesce(tx.canonical_url(F.col("content")), "url")
    none = F.lit(None).cast("string")
    fields = {
        "id": say(context, F.lit(f"/{kind}#"), F.col("index").cast("string")),
        "documentPath": say(context, F.lit(f"/{file}")),
        "documentTitle": say(context, F.lit(" Migration Guide")) if migration else context,
        "category": F.lit(category),
        "heading": tx.section_heading(heading, F.array_compact(F.array("crumb")), context),
        "content": F.col("content"),
        "metadata": F.struct(tx.extract_description(F.col("content")).alias("description"), url.alias("sourceUrl"), none.alias("method"), none.alias("path"), F.col("language").alias("language"), context.alias("repository"), none.alias("version")),
    }
    return found.select(F.col(id_col).alias(outer), "index", *(c.alias(names.get(k, k)) for k, c in fields.items()))


# Fixed value: a version heading.
VERSION = r"##?\s*\[?v?(\d+\.\d+\.\d+[^\]\n]*)\]?"


def changelog_rows(docs: DataFrame, id_col: str = "id", text_col: str = "content", config: ChunkConfig = ChunkConfig(), keep_all: bool = False) -> DataFrame:
    """(id, index, heading, content, version) of the versions in each text: small neighbours together, large ones packed by their fences.

    A large version does not end the open run of small ones, which comes behind it.  Text
    before the first version is left out, unless keep_all (its heading is null then).
    Texts without a version give no rows.
    """
    normal = tx.normalize_line_endings(F.coalesce(text_col, F.lit("")))
    cut = docs.select(F.col(id_col), F.posexplode(F.split(normal, f"(?m)(?=^{VERSION})")).alias("n", "body"))
    cut = stored(cut.select(id_col, "n", tx.js_trim(F.col("body")).alias("body"), tx.js_trim(F.regexp_extract("body", f"^{VERSION}", 1)).alias("version")), "versions")
    versions = cut.filter("version <> ''").withColumn("size", F.length("body"))
    large = F.col("size") > config.max_size
    others = versions.filter(~large).withColumn("alone", F.col("size") >= config.min_size)
    key = F.to_json(F.struct(F.col(id_col).alias("d")))
    sizes = others.select(key.alias("key"), "n", F.when(F.col("alone"), config.ideal_size + 1).otherwise(F.col("size")).alias("size"))
    packed = pack_runs(sizes, "key", "n", "size", config.ideal_size).select("key", "n", "batch")
    # a run is closed by the item behind it that is not large
    behind = F.lead("n").over(Window.partitionBy(id_col).orderBy("n"))
    others = _with(others.withColumns({"key": key, "behind": behind}), packed, "key", "n").drop("key")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    runs = others.groupBy(id_col, "batch").agg(in_order("version").alias("names"), in_order("body").alias("bodies"), F.bool_or("alone").alias("alone"), F.max_by("behind", "n").alias("behind"), F.max("n").alias("last"))
    runs = runs.withColumns({"body": F.array_join("bodies", "\n\n"), "newest": F.get("names", 0), "oldest": F.element_at("names", -1)})
    title = F.when(F.size("names") > 1, F.concat(F.lit("Versions "), "oldest", F.lit(" - "), "newest")).otherwise(F.concat(F.lit("Version "), "newest"))
    # a run that its joints have made too large is cut, and its parts are numbered but for one that is the rest alone
    pieces = _cut_at_fences(F.col("body"), config.max_size, config.min_size)
    parts = F.when(F.length("body") <= config.max_size, F.array("body")).otherwise(_with_tail(pieces, config.min_size))
    numbered = (F.length("body") > config.max_size) & ((F.col("piece") > 0) | (F.size(pieces["done"]) > 0))
    place = lambda pos, rank: F.struct(pos.cast("bigint").alias("at"), F.lit(rank).alias("rank"))
    end = F.lit(2**31)
    runs = runs.select(id_col, F.when(F.col("alone"), place(F.col("last"), 1)).otherwise(place(F.coalesce("behind", end), 0)).alias("place"), "body", title.alias("title"), F.col("newest").alias("version"), F.posexplode(parts).alias("piece", "content"))
    runs = runs.select(id_col, "place", "piece", F.when(numbered, F.concat("title", F.lit(" (Part "), (F.col("piece") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title")).alias("heading"), "content", "version")
    whole = versions.filter(large).select(id_col, place(F.col("n"), 1).alias("place"), "version", F.posexplode(_with_tail(_cut_at_fences(F.col("body"), config.max_size, config.min_size), config.min_size)).alias("piece", "content"))
    found = runs.unionByName(whole.select(id_col, "place", "piece", F.concat(F.lit("Version "), "version").alias("heading"), "content", "version"))
    if keep_all:
        first = versions.groupBy(id_col).agg(F.min_by("version", "n").alias("of"))
        before = _with(cut.filter("n = 0 and version = '' and body <> ''"), first, id_col).filter("of is not null")
        found = found.unionByName(before.select(id_col, place(F.lit(-1), 0).alias("place"), F.lit(0).alias("piece"), F.lit(None).cast("string").alias("heading"), F.col("body").alias("content"), F.col("of").alias("version")))
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("place", "piece")) - 1
    return found.select(id_col, index.cast("bigint").alias("index"), "heading", "content", "version")


def changelog_chunks_of(docs: DataFrame, id_col: str = "id", text_col: str = "content", config: ChunkConfig = ChunkConfig(), keep_all: bool = False) -> DataFrame:
    """CHUNKS of docs (id, context, content, url, language) with id_col and `index`, by changelog rules; texts without a version go by README rules."""
    names = {"id": "chunk_id"} if id_col == "id" else {}
    outer, outer_text = id_col, text_col
    docs, id_col, text_col = _inner(docs, id_col, text_col), DOC, TEXT
    has_version = F.coalesce(F.col(text_col), F.lit("")).rlike(f"(?m)^{VERSION}") | tx.normalize_line_endings(F.coalesce(text_col, F.lit(""))).rlike(f"(?m)^{VERSION}")
    rows = _with(changelog_rows(docs.filter(has_version), id_col, text_col, config, keep_all), docs.select(F.col(id_col), "context", "url", "language"), id_col)
    context, none = F.coalesce("context", F.lit("")), F.lit(None).cast("string")
    fields = {
        "id": F.concat(context, F.lit("/changelog#"), F.col("index").cast("string")),
        "documentPath": F.concat(context, F.lit("/CHANGELOG.md")),
        "documentTitle": F.concat(context, F.lit(" Changelog")),
        "category": F.lit("changelog"),
        "heading": F.coalesce("heading", F.concat(context, F.lit(" Changelog"))),
        "content": F.col("content"),
        "metadata": F.struct(tx.extract_description(F.col("content")).alias("description"), F.col("url").alias("sourceUrl"), none.alias("method"), none.alias("path"), F.col("language").alias("language"), context.alias("repository"), F.col("version").alias("version")),
    }
    rows = rows.select(F.col(id_col).alias(outer), "index", *(c.alias(names.get(k, k)) for k, c in fields.items()))
    plain = docs.filter(~has_version).select(F.col(DOC).alias(outer), F.col(TEXT).alias(outer_text), "context", "url", "language")
    return rows if plain.isEmpty() else rows.unionByName(section_chunks(plain, outer, outer_text, config, False, keep_all))


def markdown_files(files: DataFrame, config: ChunkConfig = ChunkConfig(), keep_all: bool = False) -> DataFrame:
    """CHUNKS of Markdown files (context, path, content, url, language), with their path and the chunk's place in it (`file`, `place`).

    Routed by the lower-cased path: changelogs, migration guides, and all others as READMEs.
    Paths tell the files apart.
    """
    files = stored(files.select("context", "path", "content", "url", "language").withColumn("file", F.col("path")), "files")
    name = F.lower("path")
    history, move = name.contains("changelog"), name.contains("migration") | name.contains("upgrade")
    kind = F.when(history, 0).when(move, 1).otherwise(2)
    rules = (
        lambda rows: changelog_chunks_of(rows, "file", "content", config, keep_all),
        lambda rows: section_chunks(rows, "file", "content", config, True, keep_all),
        lambda rows: section_chunks(rows, "file", "content", config, False, keep_all),
    )
    there = sorted(r[0] for r in files.select(kind).distinct().collect()) or [2]  # three kinds at most
    found = [rules[k](files.filter(kind == k)) for k in there]
    return reduce(DataFrame.unionByName, found).withColumn("place", F.col("index").cast("int")).drop("index")


def markdown_documents(files: DataFrame, config: ChunkConfig = ChunkConfig(), keep_all: bool = False) -> DataFrame:
    """CHUNKS of rows (context, path, content, url, language)."""
    return markdown_files(files, config, keep_all).drop("file", "place")

"""JSON specs as VARIANT tables: operations and schema references, without Python.

``operations`` explodes paths and methods, ``references`` follows ``$ref`` from schema to
schema of a spec by joins, twice as far in each.  YAML specs are parsed by ``openapi``;
their rendered chunks stay there.

A text that is no JSON gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored
from .openapi import METHODS, SCHEMA_PREFIX


def _named(name: str) -> str:
    """The schema's name in a $ref column."""
    return f"replace({name}, '{SCHEMA_PREFIX}', '')"


def operations(specs: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(spec, path, method, operation_id, summary, ref) of every operation of specs; ref is the schema of its JSON answer 200, if named."""
    methods = ", ".join(f"'{m}'" for m in METHODS)
    answer = """'$.responses["200"].content["application/json"].schema["$ref"]'"""
    return specs.sparkSession.sql(
        f"""select s.`{path_col}` spec, p.key path, m.key method,
          try_variant_get(m.value, '$.operationId', 'string') operation_id, try_variant_get(m.value, '$.summary', 'string') summary, {_named(f"try_variant_get(m.value, {answer}, 'string')")} ref
        from {{specs}} s, lateral variant_explode(try_variant_get(try_parse_json(s.`{content_col}`), '$.paths', 'variant')) p, lateral variant_explode(p.value) m
        where m.key in ({methods})""",
        specs=specs,
    )


def schemas(specs: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(spec, name, kind, ref) of every named schema; ref is the schema that stands in its place, if it is a reference."""
    return specs.sparkSession.sql(
        f"""select s.`{path_col}` spec, n.key name, try_variant_get(n.value, '$.type', 'string') kind, {_named("try_variant_get(n.value, '$[\"$ref\"]', 'string')")} ref
        from {{specs}} s, lateral variant_explode(try_variant_get(try_parse_json(s.`{content_col}`), '$.components.schemas', 'variant')) n""",
        specs=specs,
    )


def references(named: DataFrame) -> DataFrame:
    """(spec, name, resolved) of schemas (spec, name, ref): where the references from a name end; null at a gap or a cycle.

    Steps are doubled: a row (name, at) stands for 2^k references in a row, or, once
    `ended`, for all up to the schema at the end.  As each distance to an end is that of
    some name on the way, a round that finds no new end is the last one.
    """
    named = stored(named, "schemas")
    steps, ends = named.select("spec", "name", F.coalesce("ref", "name").alias("at"), F.col("ref").isNull().alias("ended"), F.col("ref").isNull().alias("own")).distinct(), -1
    while True:
        steps = stored(steps, "references")
        n = steps.filter("ended").count()
        if n == ends:
            break
        ends, further = n, steps.select(F.col("spec").alias("s"), F.col("name").alias("n"), F.col("at").alias("next"), F.col("ended").alias("last"))
        on = steps.filter("not ended").join(further, F.col("spec").eqNullSafe(F.col("s")) & (F.col("at") == F.col("n")))
        steps = steps.filter("ended").unionByName(on.select("spec", "name", F.col("next").alias("at"), F.col("last").alias("ended"), F.lit(False).alias("own"))).distinct()
    found = steps.filter("ended and not own").groupBy(F.col("spec").alias("s"), F.col("name").alias("n")).agg(F.max("at").alias("resolved"))
    referring = named.filter("ref is not null").select("spec", "name").distinct()
    behind = referring.join(found, F.col("spec").eqNullSafe(F.col("s")) & (F.col("name") == F.col("n")), "left").select("spec", "name", "resolved")
    return named.filter("ref is null").select("spec", "name", F.col("name").alias("resolved")).unionByName(behind)


def resolved_operations(specs: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """operations with `resolved`, the name of the schema that their answer ends at; null without one, at a gap or in a cycle."""
    found = operations(specs, path_col, content_col)
    ends = references(schemas(specs, path_col, content_col)).withColumnsRenamed({"spec": "s", "name": "n"})
    return found.join(ends, found["spec"].eqNullSafe(ends["s"]) & (found["ref"] == ends["n"]), "left").drop("s", "n")

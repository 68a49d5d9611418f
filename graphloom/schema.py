"""Explicit schemas of the graph's tables, and checks of a graph document."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULE = "id string, minified_name string, semantic_name string, semantic_confidence double, semantic_source string, source_file string, wrapKind string, range struct<startLine:int,endLine:int,charStart:int,charEnd:int>, bytes int, stmtCount int, strings array<string>, ast_fingerprint string, exports array<string>, deps_out array<string>, deps_in array<string>"
IDENTIFIER = "id string, module string, minified string, semantic string, state string, confidence double, source string, role string"
ANNOTATION = "type string, module string, line int, text string, origin string"
ENRICHMENT = "timestamp string, technique string, reference_version string, modules_enriched int, identifiers_enriched int, provenance string"
COVERAGE = "modules_total int, modules_named int, modules_ratio double, identifiers_total int, identifiers_named int, identifiers_ratio double, strings_total int"


def _fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of each column of a schema string."""
    return [tuple(f.strip().split(" ", 1)) for f in re.split(r",\s+", ddl)]


def _struct(ddl: str) -> str:
    return f"struct<{','.join(f'{n}:{t}' for n, t in _fields(ddl))}>"


GRAPH = (
    "bkg_version string, bundle struct<file:string,version:string,bundler:string,size_bytes:int,total_modules:int,total_statements:int,hash_sha256:string>, "
    "reference struct<version:string,source:string,file:string>, "
    + ", ".join(f"{name} array<{_struct(s)}>" for name, s in (("modules", MODULE), ("identifiers", IDENTIFIER), ("annotations", ANNOTATION), ("enrichments", ENRICHMENT)))
    + f", coverage {_struct(COVERAGE)}"
)


def modules_of(graphs: DataFrame, graph_id: str = "bkg_id") -> DataFrame:
    """One row per module; ``ord`` is its place in the document."""
    return graphs.select(graph_id, F.posexplode("modules").alias("ord", "m")).select(graph_id, "ord", "m.*")


def edges_of(modules: DataFrame, graph_id: str = "bkg_id") -> DataFrame:
    return modules.select(graph_id, F.col("id").alias("src"), F.explode("deps_out").alias("dst"))


def errors(graphs: DataFrame, graph_id: str = "bkg_id") -> DataFrame:
    """``(bkg_id, error)`` for every rule that a document breaks; none for a sound one."""
    checks = F.array(
        F.when(~F.col("bkg_version").eqNullSafe("1.0"), F.concat(F.lit("version is "), F.coalesce("bkg_version", F.lit("missing")))),
        F.when(F.col("bundle").isNull(), F.lit("bundle is missing")),
        F.when(F.col("modules").isNull(), F.lit("modules are missing")),
        F.when(F.col("coverage").isNull(), F.lit("coverage is missing")),
    )
    plain = graphs.select(graph_id, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("error"))
    rows = graphs.select(graph_id, F.posexplode("modules").alias("ord", "m")).select(graph_id, "ord", F.col("m.id").alias("id"))
    nameless = rows.where(F.col("id").isNull() | (F.col("id") == "")).select(graph_id, F.format_string("module %d has no id", "ord").alias("error"))
    twice = rows.where("id <> ''").groupBy(graph_id, "id").count().where("count > 1").select(graph_id, F.concat(F.lit("id used twice: "), "id").alias("error"))
    return plain.union(nameless).union(twice)


def to_graph(bundles: DataFrame, modules: DataFrame, graph_id: str = "bkg_id") -> DataFrame:
    """Graph documents from ``bundles(bkg_id, bundle)`` and module rows."""
    fields = [n for n, _ in _fields(MODULE)]
    nested = modules.groupBy(graph_id).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("m")))).alias("ms"))
    named = F.count_if(F.col("semantic_name") != "")
    cover = modules.groupBy(graph_id).agg(F.count(F.lit(1)).cast("int").alias("modules_total"), named.cast("int").alias("modules_named"), F.coalesce(F.sum(F.size("strings")), F.lit(0)).cast("int").alias("strings_total"))
    cover = cover.select(graph_id, F.struct("modules_total", "modules_named", F.try_divide("modules_named", "modules_total").alias("modules_ratio"), F.lit(0).alias("identifiers_total"), F.lit(0).alias("identifiers_named"), F.lit(0.0).alias("identifiers_ratio"), "strings_total").alias("coverage"))
    empty = lambda s: F.array().cast(f"array<{_struct(s)}>")
    return bundles.join(nested, graph_id, "left").join(cover, graph_id, "left").select(
        graph_id, F.lit("1.0").alias("bkg_version"), "bundle", F.lit(None).cast("struct<version:string,source:string,file:string>").alias("reference"),
        F.coalesce(F.transform("ms", lambda x: x["m"]), empty(MODULE)).alias("modules"), empty(IDENTIFIER).alias("identifiers"), empty(ANNOTATION).alias("annotations"), empty(ENRICHMENT).alias("enrichments"), "coverage",
    )

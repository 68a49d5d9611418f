"""From traced modules to graph modules: text, names, strings, fingerprints, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import numbered, slices, utf16_length
from graphloom.operators import boundary, profile
from graphloom.parse.facts import features_of, parseable

CAP = 50


def split_modules(bundles: DataFrame, rollup: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Module rows with their text (first to last statement), file name and whether they parse."""
    # a bundle's modules are cut out of its text at once, so that the text does not travel with each
    per = rollup.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("module_id", "char_start", "char_end"))).alias("m"))
    cut = bundles.select(key, "code").join(per, key).select(key, F.arrays_zip(F.col("m.module_id").alias("module_id"), slices()("code", "m.char_start", "m.char_end").alias("text")).alias("z"))
    rows = rollup.join(cut.select(key, F.explode("z").alias("z")).select(key, "z.module_id", "z.text"), [key, "module_id"])
    label = F.when(F.col("wrapKind") == "RUNTIME", "RUNTIME").when((F.col("wrapKind") == "None") & (F.col("n") > 5), "TOPLEVEL").otherwise(F.coalesce("first_name", "wrapKind"))
    out = rows.withColumn("filename", F.concat(F.lit("mod_"), numbered(F.col("module_id")), F.lit("_"), label, F.lit(".js")))
    return out.withColumn("parseable", parseable()("text"))


def graph_modules(split: DataFrame, edges: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Rows of the graph's module table from split modules and module edges."""
    named = split.select(key, "module_id", F.concat(F.lit("mod:"), F.coalesce("first_name", F.col("module_id").cast("string"))).alias("id"), F.coalesce("first_name", F.col("module_id").cast("string")).alias("minified_name"))
    ends = edges.join(named.select(key, F.col("module_id").alias("src"), F.col("id").alias("a")), [key, "src"]).join(named.select(key, F.col("module_id").alias("dst"), F.col("id").alias("b")), [key, "dst"])
    ordered = lambda n, v: F.transform(F.array_sort(F.collect_list(F.struct(n, v))), lambda x: x[v])
    out = ends.groupBy(key, F.col("src").alias("module_id")).agg(ordered("dst", "b").alias("deps_out"))
    into = ends.groupBy(key, F.col("dst").alias("module_id")).agg(ordered("src", "a").alias("deps_in"))
    none = F.array().cast("array<string>")
    rows = split.withColumn("f", features_of()("text")).join(named, [key, "module_id"]).join(out, [key, "module_id"], "left").join(into, [key, "module_id"], "left")
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        F.col(key).alias("bkg_id"), F.col("module_id").alias("ord"), "id", "minified_name", null("string").alias("semantic_name"), null("double").alias("semantic_confidence"), null("string").alias("semantic_source"), null("string").alias("source_file"), "wrapKind",
        F.struct(F.col("line_start").alias("startLine"), F.col("line_end").alias("endLine"), F.col("char_start").alias("charStart"), F.col("char_end").alias("charEnd")).alias("range"), utf16_length("text").alias("bytes"), F.col("stmt_count").cast("int").alias("stmtCount"),
        F.slice("f.strings", 1, CAP).alias("strings"), F.col("f.fingerprint").alias("ast_fingerprint"), F.when(F.col("first_name").isNotNull(), F.array("first_name")).otherwise(none).alias("exports"), F.coalesce("deps_out", none).alias("deps_out"), F.coalesce("deps_in", none).alias("deps_in"),
    )


def bundle_graph(bundles: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``bundles(bundle_id, code)`` to graph modules: parse, trace, split and extract in one plan."""
    stmts = profile.statements_of(bundles, key)
    assigned = boundary.assign_modules(stmts, key)
    split = split_modules(bundles, boundary.module_rollup(stmts, assigned, key), key)
    return graph_modules(split, boundary.module_edges(boundary.statement_edges(stmts, key), assigned, key), key)


def split_stats(split: DataFrame, bundles: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Per bundle and kind: modules, bytes; and the share of the source that they cover."""
    size = bundles.select(key, utf16_length("code").alias("size"))
    sums = split.groupBy(key, "wrapKind").agg(F.count(F.lit(1)).alias("modules"), F.sum(utf16_length("text")).alias("bytes"), F.count_if("parseable").alias("parseable"))
    return sums.join(size, key).withColumn("coverage", F.format_string("%.1f", F.col("bytes") * 100.0 / F.col("size"))).drop("size")

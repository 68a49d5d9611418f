"""Texts made from tables: module headers, reassembled sources, a map of a bundle as HTML."""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOURS = {"CJS": "#4e79a7", "ESM": "#59a14f", "IMPORT": "#f28e2b", "RUNTIME": "#e15759", "None": "#bab0ac"}


def _list(items: Column, n: int) -> Column:
    more = F.when(F.size(items) > n, F.format_string(" (+%d more)", F.size(items) - n)).otherwise("")
    return F.when(F.size(items) == 0, "none").otherwise(F.concat(F.array_join(F.slice(items, 1, n), ", "), more))


def find_module(files: DataFrame, modules: DataFrame, key: str = "bkg_id") -> DataFrame:
    """``files(bkg_id, filename)`` with their modules: by minified name, then number, then id."""
    name = F.regexp_extract("filename", r"^mod_[^_]*_(.*)\.js$", 1)
    number = F.concat(F.lit("mod:"), F.regexp_extract("filename", r"^mod_0*(\d+)_", 1))
    rows = files.withColumn("__name", name).withColumn("__number", number)
    last = modules.groupBy(key, "minified_name").agg(F.max_by("id", "ord").alias("by_name"))
    ids = modules.select(key, F.col("id").alias("by_id"))
    rows = rows.join(last.withColumnRenamed("minified_name", "__name"), [key, "__name"], "left")
    rows = rows.join(ids.select(key, F.col("by_id").alias("__number"), F.col("by_id").alias("by_number")), [key, "__number"], "left")
    rows = rows.join(ids.select(key, F.substring("by_id", 5, 10_000).alias("__name"), "by_id"), [key, "__name"], "left")
    return rows.withColumn("id", F.coalesce("by_name", "by_number", "by_id")).drop("__name", "__number", "by_name", "by_number", "by_id")


def paired_files(targets: DataFrame, refs: DataFrame, modules: DataFrame, key: str = "pair", spread: bool = True) -> DataFrame:
    """``(pair, minified_name, ref_name, target_code, ref_code)``: files of matched modules side by side.

    ``targets`` and ``refs`` are ``(pair, filename, name, text)``, ``modules`` the matched graph.  A name that spread from a
    neighbour stands for that neighbour's if ``spread`` is set.  Of files of one name the last counts; the runtime has none.
    """
    last = lambda df, name, text: df.groupBy(key, F.col("name").alias(name)).agg(F.max_by("text", "filename").alias(text))
    name = F.regexp_replace("semantic_name", "^near_", "") if spread else F.col("semantic_name")
    known = modules.where((F.coalesce("semantic_name", F.lit("")) != "") & ~F.col("minified_name").eqNullSafe("RUNTIME")).select(key, "minified_name", name.alias("ref_name"))
    return known.join(last(targets, "minified_name", "target_code"), [key, "minified_name"]).join(last(refs, "ref_name", "ref_code"), [key, "ref_name"])


def name_header(modules: DataFrame) -> DataFrame:
    """Modules with ``header``: name, certainty, neighbours and a few strings."""
    sure = F.when(F.col("semantic_confidence").isNotNull(), F.format_string(" (%.0f%%)", F.col("semantic_confidence") * 100)).otherwise("")
    title = F.when(F.coalesce("semantic_name", F.lit("")) != "", F.concat("semantic_name", sure)).otherwise(F.lit("unnamed"))
    shown = F.transform(F.slice("strings", 1, 3), lambda s: F.substring(s, 1, 30))
    return modules.withColumn("header", F.concat(
        F.lit("// name: "), title, F.lit("\n// source: "), F.coalesce("semantic_source", F.lit("none")), F.lit("\n// depends on: "), _list(F.col("deps_out"), 5),
        F.lit("\n// used by: "), _list(F.col("deps_in"), 5), F.lit("\n// strings: "), F.array_join(shown, " | "), F.lit("\n"),
    ))


def doc_header(modules: DataFrame, key: str = "bkg_id") -> DataFrame:
    """Modules with ``header`` as a documentation comment; dependencies by their best names."""
    label = F.when(F.coalesce("semantic_name", F.lit("")) != "", F.col("semantic_name")).otherwise(F.col("minified_name"))
    names = modules.select(key, F.col("id").alias("dep"), label.alias("dep_name"))
    deps = modules.select(key, "id", F.posexplode("deps_out").alias("pos", "dep")).join(names, [key, "dep"], "left")
    joined = deps.groupBy(key, "id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("dep_name", "dep").alias("n")))).alias("d"))
    rows = modules.join(joined, [key, "id"], "left")
    imports = F.transform(F.coalesce("d", F.array().cast("array<struct<pos:int,n:string>>")), lambda x: x["n"])
    return rows.withColumn("header", F.concat(
        F.lit("/**\n * @module "), "id", F.lit("\n * @name "), label, F.lit("\n * @source "), F.coalesce("source_file", F.lit("unknown")), F.lit("\n * @matched "), F.coalesce("semantic_source", F.lit("none")),
        F.lit("\n * @wrap "), "wrapKind", F.lit("\n * @imports "), _list(imports, 15), F.format_string("\n * @importedBy %d", F.size("deps_in")), F.format_string("\n * @stats %d statements, %d bytes\n */\n", "stmtCount", "bytes"),
    )).drop("d")


def reassemble(files: DataFrame, key: str = "bkg_id", markers: bool = True) -> DataFrame:
    """``files(bkg_id, ord, filename, text)`` to one text per bundle, in order of the manifest."""
    mark = F.concat(F.lit("// --- "), "filename", F.lit(" ---\n")) if markers else F.lit("")
    rows = files.select(key, F.struct("ord", F.concat(mark, "text").alias("t")).alias("x"))
    return rows.groupBy(key).agg(F.concat(F.lit("#!/usr/bin/env node\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n")).alias("text"))


def bundle_map(modules: DataFrame, title: str, top: int = 15, strips: int = 20_000) -> str:
    """An HTML page: a strip of all modules by size, a legend, the ``top`` largest.

    Takes one bundle's rows; more than ``strips`` modules are refused with ``ValueError``.
    """
    rows = modules.select("ord", "id", "wrapKind", "bytes").orderBy("ord").limit(strips + 1).collect()
    if len(rows) > strips:
        raise ValueError(f"more than {strips} modules")
    total, x, bars = sum(r["bytes"] for r in rows) or 1, 0.0, []
    for r in rows:
        w = max(1, r["bytes"] / total * 1200)
        bars.append(f'<rect x="{x:.1f}" y="0" width="{w:.1f}" height="60" fill="{COLOURS.get(r["wrapKind"], "#999")}"><title>{escape(str(r["id"]))}: {r["bytes"]} bytes</title></rect>')
        x += w
    kinds: dict[str, list[int]] = {}
    for r in rows:
        kinds.setdefault(r["wrapKind"], [0, 0])
        kinds[r["wrapKind"]][0] += 1
        kinds[r["wrapKind"]][1] += r["bytes"]
    legend = "".join(f'<li style="color:{COLOURS.get(k, "#999")}">{escape(k)}: {n} modules, {b} bytes</li>' for k, (n, b) in sorted(kinds.items(), key=lambda v: -v[1][1]))
    table = "".join(f"<tr><td>{escape(str(r['id']))}</td><td>{escape(r['wrapKind'])}</td><td>{r['bytes']}</td></tr>" for r in sorted(rows, key=lambda r: (-r["bytes"], r["ord"]))[:top])
    return f"<!doctype html><meta charset='utf-8'><title>{escape(title)}</title><h1>{escape(title)}</h1><svg width='{max(x, 1):.0f}' height='60'>{''.join(bars)}</svg><ul>{legend}</ul><table>{table}</table>"

"""Whole-graph operations: statistics, coverage, merge, difference, recurrence filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.schema import modules_of

COMMON = ("__esModule", "default", "function", "object", "string", "number", "undefined", "null", "true", "false")


def named(name: Column) -> Column:
    return F.coalesce(name, F.lit("")) != ""


def graph_stats(modules: DataFrame, by: list[str]) -> DataFrame:
    """Per graph: modules, named ones, strings, fingerprints, bytes."""
    return modules.groupBy(*by).agg(
        F.count(F.lit(1)).alias("modules"), F.count_if(named(F.col("semantic_name"))).alias("named"), F.sum(F.size("strings")).alias("strings"),
        F.count_if(F.coalesce("ast_fingerprint", F.lit("")) != "").alias("fingerprints"), F.sum("bytes").alias("bytes"), F.round(F.count_if(named(F.col("semantic_name"))) / F.count(F.lit(1)), 6).alias("named_ratio"),
    )


def identifier_coverage(identifiers: DataFrame, by: list[str]) -> DataFrame:
    """Counts by state and the shares that are semantic, and semantic or placeholder."""
    n = {s: F.count_if(F.col("state") == s) for s in ("semantic", "placeholder", "raw")}
    total = F.count(F.lit(1))
    return identifiers.groupBy(*by).agg(*(c.alias(f"identifiers_{s}") for s, c in n.items()), F.round(n["semantic"] / total, 6).alias("coverage_semantic"), F.round((n["semantic"] + n["placeholder"]) / total, 6).alias("coverage_touched"))


def merge_modules(a: DataFrame, b: DataFrame, by: tuple[str, ...] = (), cap: int = 50) -> DataFrame:
    """Full outer merge on id: the surer name wins (ties: side 1); other fields come from side 1.

    ``conflict`` marks rows where side 2 replaced another name.  ``strings`` is side 1's and what
    side 2 adds, the first ``cap``.
    """
    keys = [*by, "id"]
    fields = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*fields).alias("a"))
    y = b.select(*keys, F.struct(*fields).alias("b"))
    j = x.join(y, keys, "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    surer = both & (F.coalesce("b.semantic_confidence", F.lit(0.0)) > F.coalesce("a.semantic_confidence", F.lit(0.0))) & named(F.col("b.semantic_name"))
    out = []
    for f in fields:
        one = F.when(F.col("a").isNull(), F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
        if f in ("semantic_name", "semantic_confidence", "semantic_source"):
            one = F.when(surer, F.col(f"b.{f}")).otherwise(one)
        elif f == "strings":
            one = F.when(both & F.col("a.strings").isNotNull() & F.col("b.strings").isNotNull(), F.slice(F.array_distinct(F.concat("a.strings", "b.strings")), 1, cap)).otherwise(one)
        elif f == "source_file":
            one = F.when(both & ~named(F.col("a.source_file")) & named(F.col("b.source_file")), F.col("b.source_file")).otherwise(one)
        out.append(one.alias(f))
    conflict = surer & named(F.col("a.semantic_name")) & (F.col("a.semantic_name") != F.col("b.semantic_name"))
    return j.select(*keys, *out, F.coalesce(conflict, F.lit(False)).alias("conflict"))


def merge_identifiers(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The surer row of each id (ties: side 1)."""
    keys = [*by, "id"]
    fields = [c for c in a.columns if c not in keys]
    j = a.select(*keys, F.struct(*fields).alias("a")).join(b.select(*keys, F.struct(*fields).alias("b")), keys, "full_outer")
    second = F.col("a").isNull() | (F.col("b").isNotNull() & (F.coalesce("b.confidence", F.lit(0.0)) > F.coalesce("a.confidence", F.lit(0.0))))
    return j.select(*keys, F.when(second, F.col("b")).otherwise(F.col("a")).alias("x")).select(*keys, "x.*")


def merge_documents(a: DataFrame, b: DataFrame, key: str = "bkg_id", at: Column | None = None, cap: int = 50) -> DataFrame:
    """Graph documents of both sides (see ``schema.GRAPH``), one for each key that both have.

    Modules follow :func:`merge_modules`; of identifiers the surer stays (ties: side 1).  Both keep side 1's order
    before what side 2 adds.  Annotations and enrichments are strung together, and the merge itself is
    the last enrichment, at the time ``at``.  A list that is null counts as empty.
    """
    at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSX") if at is None else at
    shared = a.select(key).join(b.select(key), key, "left_semi")
    place = lambda df, side: modules_of(df.join(shared, key, "left_semi"), key).withColumn("ord", F.struct(F.lit(side).alias("side"), "ord"))
    merged = merge_modules(place(a, 0), place(b, 1), (key,), cap)
    fields = [c for c in merged.columns if c not in (key, "ord", "conflict")]
    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ord", x.alias("x")))), lambda p: p["x"])
    modules = merged.groupBy(key).agg(in_order(F.struct(*fields)).alias("modules"), F.count(F.lit(1)).cast("int").alias("modules_total"), F.count_if(named(F.col("semantic_name"))).cast("int").alias("modules_named"), F.count_if("conflict").alias("conflicts"))

    each = lambda df, side: df.join(shared, key, "left_semi").select(key, F.posexplode("identifiers").alias("pos", "x")).select(key, F.col("x.id").alias("id"), F.struct(F.lit(side).alias("side"), "pos").alias("ord"), "x")
    surer = F.struct(F.coalesce("x.confidence", F.lit(0.0)).alias("c"), (-F.col("ord.side")).alias("s"))
    kept = each(a, 0).union(each(b, 1)).groupBy(key, "id").agg(F.max_by("x", surer).alias("x"), F.min("ord").alias("ord"))
    states = ("semantic", "placeholder", "raw")
    identifiers = kept.groupBy(key).agg(in_order(F.col("x")).alias("identifiers"), *(F.count_if(F.col("x.state") == s).cast("int").alias(f"identifiers_{s}") for s in states))

    rest = lambda df, p: df.select(key, *(F.col(c).alias(f"{p}_{c}") for c in ("bundle", "reference", "annotations", "enrichments", "identifiers")))
    j = rest(a, "a").join(rest(b, "b"), key).join(modules, key, "left").join(identifiers, key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    kinds = {c: a.schema[c].dataType.simpleString() for c in ("identifiers", "annotations", "enrichments")}
    both = lambda c: F.concat(*(F.coalesce(f"{p}_{c}", F.array().cast(kinds[c])) for p in "ab"))
    entry = F.struct(at.alias("timestamp"), F.lit("merge").alias("technique"), F.lit(None).cast("string").alias("reference_version"), zero("modules_total").alias("modules_enriched"), zero(F.size("identifiers")).alias("identifiers_enriched"), F.format_string("merge: %d conflicts resolved by confidence", zero("conflicts")).alias("provenance"))
    log = F.array(entry).cast(kinds["enrichments"])
    cover = F.struct(*(zero(c).alias(c) for c in ("modules_named", "modules_total", *(f"identifiers_{s}" for s in states))), F.lit(0).alias("identifier_coverage_semantic"), F.lit(0).alias("identifier_coverage_touched"))
    return j.select(key, F.lit("1.0").alias("bkg_version"), F.col("a_bundle").alias("bundle"), F.coalesce("a_reference", "b_reference").alias("reference"), F.coalesce("modules", F.array().cast(modules.schema["modules"].dataType)).alias("modules"), F.coalesce("identifiers", both("identifiers")).alias("identifiers"), both("annotations").alias("annotations"), F.concat(both("enrichments"), log).alias("enrichments"), cover.alias("coverage"))


def diff(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``(id, status, name_changed, deps_changed, bytes_changed)``; one full outer join."""
    keys = [*by, "id"]
    pick = lambda df, p: df.select(*keys, F.lit(True).alias(f"{p}_here"), *(F.col(c).alias(f"{p}_{c}") for c in ("semantic_name", "deps_out", "bytes")))
    j = pick(a, "a").join(pick(b, "b"), keys, "full_outer")
    shared = F.col("a_here") & F.col("b_here")
    changed = lambda c: F.coalesce(shared & c, F.lit(False))
    return j.select(
        *keys, F.when(F.col("a_here").isNull(), "added").when(F.col("b_here").isNull(), "removed").otherwise("shared").alias("status"),
        changed(~F.col("a_semantic_name").eqNullSafe(F.col("b_semantic_name"))).alias("name_changed"), changed(~F.col("a_deps_out").eqNullSafe(F.col("b_deps_out"))).alias("deps_changed"),
        changed(F.abs(F.col("a_bytes") - F.col("b_bytes")) > F.col("a_bytes") * 0.1).alias("bytes_changed"),
    )


def diff_summary(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "shared")), *(F.count_if(c).alias(c) for c in ("name_changed", "deps_changed", "bytes_changed")))


def content_key() -> Column:
    """What two modules have in common when they count as the same content."""
    return F.struct(F.array_sort("strings").alias("strings"), F.coalesce("ast_fingerprint", F.lit("")).alias("fp"), (F.floor(F.coalesce("bytes", F.lit(0)) / 256) * 256).alias("size"))


def evolve(modules: DataFrame, pair: str = "pair", threshold: int | None = None, inputs: int | None = None) -> DataFrame:
    """Modules of several inputs whose content does not recur in most of them, largest first.

    Content counts once per input; it is noise from ``max(2, ceil(5 N / 6))`` inputs on; N is ``inputs``, to be
    given where some input has no rows, else the number of inputs that have some.  The
    content key is hashed once (128 bits), so wide keys do not travel twice.
    """
    n = 0 if threshold is not None else inputs if inputs is not None else modules.select(pair).distinct().count()
    least = threshold if threshold is not None else max(2, -(-5 * n // 6))
    key = content_key()
    rows = modules.withColumn("k1", F.xxhash64(key)).withColumn("k2", F.xxhash64(F.lit(7), key))
    noise = rows.select("k1", "k2", pair).distinct().groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("inputs")).where(F.col("inputs") >= least)
    fresh = rows.join(noise.select("k1", "k2"), ["k1", "k2"], "left_anti").drop("k1", "k2")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy(pair).orderBy(F.desc("bytes"), "ord")))


def evolve_report(modules: DataFrame, fresh: DataFrame, pair: str = "pair") -> DataFrame:
    """Per input: unmatched modules, real new ones, noise filtered, counts by kind."""
    raw = modules.groupBy(pair).agg(F.count(F.lit(1)).alias("unmatched_raw"))
    kinds = fresh.groupBy(pair, "wrapKind").agg(F.count(F.lit(1)).alias("n")).groupBy(pair).agg(F.sum("n").alias("real_new"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("wrapKind", "n")))).alias("new_by_wrap_kind"))
    out = raw.join(kinds, pair, "left").withColumn("real_new", F.coalesce("real_new", F.lit(0)))
    return out.withColumn("noise_filtered", F.col("unmatched_raw") - F.col("real_new"))


def sample_strings(n: int = 6) -> Column:
    """The first telling strings of a module."""
    return F.slice(F.filter("strings", lambda s: (F.length(s) > 4) & ~s.isin(*COMMON)), 1, n)


def with_string(modules: DataFrame, pattern: str) -> DataFrame:
    """Modules in which some string matches."""
    return modules.where(F.exists("strings", lambda s: s.rlike(pattern)))


def pick_per_group(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)

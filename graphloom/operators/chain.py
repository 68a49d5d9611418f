"""Names carried along a chain of versions, and checks of module counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import propagate
from graphloom.operators.match import cascade_exact, transfer
from graphloom.sources.tables import settled


def chain(modules: DataFrame, versions: list[str], graph: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(modules, report)``: each version is matched against the enriched one before it, then names spread.

    ``modules(bkg_id, ...)`` holds all versions.  Steps depend on each other, so they run in order;
    ``graph`` names the column that tells bundles apart, whose steps run side by side, a task each.
    The report has one row per link.
    """
    if len(versions) < 2:
        raise ValueError("a chain needs two versions")
    spark = modules.sparkSession
    keyed = modules.withColumn("pair", F.col(graph).cast("string") if graph else F.lit(""))
    of = lambda v: keyed.where(F.col("bkg_id") == v)
    done, links, ref = [of(versions[0])], [], of(versions[0])
    for old, new in zip(versions, versions[1:], strict=False):
        target = of(new)
        found = settled(cascade_exact(target, ref), "links")
        ref = settled(propagate(transfer(target, ref, found, ["pair"]), "pair"), "version")
        done.append(ref)
        total, matched = target.count(), found.count()
        links.append((old, new, matched, total, matched / total if total else 0.0))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("pair"), spark.createDataFrame(links, "old string, new string, matched long, total long, ratio double")


def module_count_check(traced: DataFrame, maps: DataFrame, limits: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """``traced(name, total, runtime, imports)`` against ``maps(name, n_sources)``; ``limits(name, known_limitation)``.

    Modules of the runtime and of imports do not count; one off is tolerated.  ``targets(name,
    has_config, has_bundle)`` are what is to be checked, by default whatever has a count: those without a
    configuration are skipped, those without a bundle reported.  A target with a known limitation that has both counts gets that status whatever they are.
    """
    j = maps.join(traced, "name", "full_outer")
    j = j.withColumns({"has_config": F.lit(True), "has_bundle": F.lit(True)}) if targets is None else targets.join(j, "name", "left")
    j = j.join(limits, "name", "left")
    countable = F.col("total") - F.col("runtime") - F.col("imports")
    gap = F.abs(countable - F.col("n_sources"))
    status = F.when(~F.col("has_config"), "SKIP").when(~F.col("has_bundle"), "NO_BUNDLE").when(F.col("n_sources").isNull(), "NO_MAP").when(F.col("total").isNull(), "NO_TRACE").when(F.col("known_limitation").isNotNull(), "KNOWN_LIMITATION").when(gap == 0, "EXACT").when(gap == 1, "OFF_BY_ONE").otherwise("MISMATCH")
    return j.select("name", countable.alias("countable"), "n_sources", (countable - F.col("n_sources")).alias("diff"), status.alias("status"))


def status_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))

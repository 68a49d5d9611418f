"""Renaming identifiers in module text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import replaced
from graphloom.parse.facts import bindings_of, parseable


def first_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """One semantic name for each (module, minified): the first given (``ord``)."""
    return pairs.groupBy(*by, "module", "minified").agg(F.min_by("semantic", "ord").alias("semantic"), F.min("ord").alias("ord"))


def claims(pairs: DataFrame, taken: DataFrame, by: list[str]) -> DataFrame:
    """Pairs whose new name is free: not used anywhere (``taken(name)``), and claimed first.

    Modules come in ``module_ord``, pairs within them in ``ord``.
    """
    free = pairs.join(taken.select(*by, F.col("name").alias("semantic")).distinct(), [*by, "semantic"], "left_anti")
    w = Window.partitionBy(*by, "semantic").orderBy("module_ord", "ord")
    return free.withColumn("claim", F.row_number().over(w)).where("claim = 1").drop("claim")


def names_in_use(modules: DataFrame, by: list[str]) -> DataFrame:
    """Every identifier that some module's text uses."""
    return modules.select(*by, F.explode(bindings_of()("text")).alias("b")).select(*by, F.col("b.name").alias("name")).distinct()


def apply_renames(modules: DataFrame, pairs: DataFrame, by: list[str], key: str = "module") -> DataFrame:
    """Modules with ``renamed`` text and ``replaced`` count; text that no longer parses is left as it was.

    Names of one letter and names that the module does not declare are skipped.  Occurrences are
    taken from one parse; the text is put together from slices in order.
    """
    spots = modules.select(*by, key, F.explode(bindings_of()("text")).alias("b")).select(*by, key, F.col("b.name").alias("minified"), "b.start", "b.end", "b.role")
    known = spots.where("role = 'declaration'").select(*by, key, "minified").distinct()
    wanted = pairs.where(F.length("minified") > 1).join(known, [*by, key, "minified"], "left_semi").select(*by, key, "minified", "semantic")
    hits = spots.join(wanted, [*by, key, "minified"]).select(*by, key, "start", "end", "semantic").distinct()
    per = hits.groupBy(*by, key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "semantic"))).alias("hits"))
    rows = modules.join(per, [*by, key], "left")
    new = replaced()("text", "hits.start", "hits.end", "hits.semantic")
    tried = rows.withColumn("new", F.coalesce(new, F.col("text"))).withColumn("ok", parseable()("new"))
    return tried.withColumn("renamed", F.when(F.col("ok"), F.col("new")).otherwise(F.col("text"))).withColumn("replaced", F.when(F.col("ok"), F.coalesce(F.size("hits"), F.lit(0))).otherwise(0)).withColumn("reverted", ~F.col("ok")).drop("hits", "new", "ok")

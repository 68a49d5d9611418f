"""Alignment of declarations by position, pair votes and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.infer import RESERVED, unreserved
from graphloom.parse.facts import bindings_of, declarations_of, scopes_of


def align_scopes(pairs: DataFrame, reserved: DataFrame | None = None, tolerance: int = 0, key: str = "pair") -> DataFrame:
    """``pairs(pair, target_code, ref_code)`` to ``(pair, scope, var, minified, semantic)``.

    Scopes and their variables are zipped by position.  Texts with equally many scopes align where a
    scope has equally many variables on both sides; texts whose scopes differ by up to ``tolerance``
    align as far as both go, where the variables of a scope differ by no more than that.  Equal names,
    new names under two letters, names that are reserved everywhere and those of ``reserved(name)`` or
    ``reserved(pair, name)`` are left out, on either side.
    """
    both = pairs.select(key, scopes_of()("target_code").alias("t"), scopes_of()("ref_code").alias("r"))
    gap = F.abs(F.size("t") - F.size("r"))
    near = both.where(gap <= tolerance).withColumn("slack", F.when(gap == 0, 0).otherwise(tolerance))
    zip_ = lambda n: F.arrays_zip(*(F.slice(c, 1, n).alias(c) for c in "tr"))
    at = near.select(key, "slack", F.posexplode(zip_(F.least(F.size("t"), F.size("r")))).alias("scope", "z")).select(key, "slack", "scope", "z.t", "z.r")
    level = at.where(F.abs(F.size("t") - F.size("r")) <= F.col("slack"))
    zipped = level.select(key, "scope", F.posexplode(zip_(F.least(F.size("t"), F.size("r")))).alias("var", "z")).select(key, "scope", "var", F.col("z.t").alias("minified"), F.col("z.r").alias("semantic"))
    out = zipped.where((F.col("minified") != F.col("semantic")) & (F.length("semantic") >= 2) & ~F.col("minified").isin(*RESERVED) & ~F.col("semantic").isin(*RESERVED))
    return out if reserved is None else unreserved(unreserved(out, reserved, key), reserved, key, "semantic")


def runtime_names(split: DataFrame, key: str = "bundle_id") -> DataFrame:
    """``(bundle_id, name)``: every identifier that the runtime module of a bundle uses."""
    runtime = split.where("wrapKind = 'RUNTIME'")
    return runtime.select(key, F.explode(bindings_of()("text")).alias("b")).select(key, F.col("b.name").alias("name")).distinct()


def vote(raw: DataFrame, by: list[str], share: float = 0.7) -> DataFrame:
    """The semantic name of each minified one, where it is the only one or has more than ``share``."""
    n = raw.groupBy(*by, "minified", "semantic").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "minified")
    ranked = n.withColumns({"total": F.sum("n").over(w), "kinds": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy(F.desc("n"), "semantic"))})
    sure = (F.col("kinds") == 1) | (F.col("n") / F.col("total") > share)
    return ranked.where((F.col("rank") == 1) & sure).select(*by, "minified", "semantic", "n", (F.col("n") / F.col("total")).alias("confidence"))


def align_declarations(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """Zips declared names of texts with equally many: ``(pair, ord, minified, semantic)``."""
    d = pairs.select(key, declarations_of()("target_code").alias("t"), declarations_of()("ref_code").alias("r")).where("size(t) = size(r)")
    return d.select(key, F.explode(F.arrays_zip("t", "r")).alias("z")).select(key, "z.t.ord", F.col("z.t.name").alias("minified"), F.col("z.r.name").alias("semantic"))


def declaration_quality(pairs: DataFrame, key: str = "pair") -> DataFrame:
    """Per pair: both counts and ``exact``, ``close`` (off by at most two) or ``mismatch``."""
    n = pairs.select(key, F.size(declarations_of()("target_code")).alias("t"), F.size(declarations_of()("ref_code")).alias("r"))
    return n.withColumn("status", F.when(F.col("t") == F.col("r"), "exact").when(F.abs(F.col("t") - F.col("r")) <= 2, "close").otherwise("mismatch"))


def zipped_words(pairs: DataFrame, by: list[str]) -> DataFrame:
    """``(*by, minified, semantic)``: the words of two texts by place, as far as both go; texts travel whole, not by word."""
    words = pairs.select(*by, F.split("minified", " ").alias("a"), F.split("semantic", " ").alias("b"))
    n = F.least(F.size("a"), F.size("b"))
    cut = words.where("a is not null and b is not null").select(*by, F.explode(F.arrays_zip(F.slice("a", 1, n).alias("minified"), F.slice("b", 1, n).alias("semantic"))).alias("z"))
    return cut.select(*by, "z.minified", "z.semantic")


def name_quality(zipped: DataFrame, by: list[str]) -> DataFrame:
    """How many aligned names are the same, renamed, or too short to tell."""
    same, short = F.col("minified") == F.col("semantic"), F.length("semantic") < 2
    return zipped.groupBy(*by).agg(F.count_if(same).alias("identity"), F.count_if(~same & ~short).alias("renamed"), F.count_if(~same & short).alias("short"))

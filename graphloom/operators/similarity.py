"""Set-similarity joins, the top-two gate and one-to-one assignment.

Pairs come from an equi-join on set members, so only pairs that share one are ever formed, between distinct
sets where nothing but the set counts; sets that share frequent members alone are compared by profile, not one by
one.  No member is dropped: every score is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import settled


def fingerprint_similarity(a: Column, b: Column) -> Column:
    """Shared kinds over the larger number of kinds, times the ratio of lengths; 0 if either is missing."""
    x, y = F.split(a, ":"), F.split(b, ":")
    sx, sy = F.array_distinct(x), F.array_distinct(y)
    value = F.size(F.array_intersect(sx, sy)) / F.greatest(F.size(sx), F.size(sy)) * (F.least(F.size(x), F.size(y)) / F.greatest(F.size(x), F.size(y)))
    return F.when((F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0), value).otherwise(F.lit(0.0))


def overlaps(t: DataFrame, r: DataFrame, members: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, t_id, t_ord, r_id, r_ord, shared, t_size, r_size)`` of all pairs with a common member."""
    by = list(by)

    def side(df: DataFrame, p: str) -> DataFrame:
        own = F.array_distinct(members)
        return df.select(*by, F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"), F.size(own).alias(f"{p}_size"), F.explode(own).alias("member"))

    both = side(t, "t").join(side(r, "r"), [*by, "member"])
    return both.groupBy(*by, "t_id", "t_ord", "r_id", "r_ord", "t_size", "r_size").agg(F.count(F.lit(1)).alias("shared"))


def jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.col("shared") / (F.col("t_size") + F.col("r_size") - F.col("shared")))


def top_two(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The best row of each target (ties: first reference) with the runner-up's score as ``second``."""
    w = Window.partitionBy(*by, "t_id").orderBy(F.desc("score"), "r_ord")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    second = F.coalesce(F.lead("score").over(w), F.lit(0.0))
    return ranked.withColumn("second", second).where("rank = 1").drop("rank")


def gate(best: DataFrame, least: float, ratio: float) -> DataFrame:
    """Rows good enough, and enough better than their runner-up."""
    return best.where((F.col("score") >= least) & ((F.col("second") == 0) | (F.col("score") >= F.col("second") * ratio)))


def assign(best: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One target for each reference: the highest score, ties to the first target.

    ``accepted`` counts, per ``by``, targets that held their reference at some time when targets
    are taken in order (evicted ones too).
    """
    w = Window.partitionBy(*by, "r_id")
    before = F.max("score").over(w.orderBy("t_ord").rowsBetween(Window.unboundedPreceding, -1))
    held = best.withColumn("held", before.isNull() | (F.col("score") > before))
    return held.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "t_ord")))


def hot_members(sides: Sequence[DataFrame], by: Sequence[str] = (), most: int = 64) -> DataFrame:
    """``(*by, member)`` of the members that more than ``most`` rows of either side have, of ``(*by, member)`` rows.

    Any other member yields at most ``most`` pairs for each row that has it.
    """
    on = [*by, "member"]
    one, two = (df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*on) for df in sides)
    return one.join(two, on, "left_semi")


def best_seeds(t: DataFrame, r: DataFrame, by: Sequence[str] = (), least: float = 0.15, ratio: float = 1.3) -> DataFrame:
    """``(*by, t_id, t_ord, r_id, r_ord, score, second)``: targets whose best reference passes the gate.

    Scores depend on the sets of strings only, so sets meet sets, however many modules have them: each
    set of references stands for its first two.  Pairs well under ``least / ratio`` neither pass nor block.

    Sets that share a string of few sets are paired by it.  Any other pair shares hot strings alone, so that its score
    is equal for all sets of one profile (hot strings, size): profiles meet profiles, each stands for its first two
    references, and each profile of targets keeps two of them.  For pairs of the first kind that is a lower bound.
    """
    by, key, profile, floor = list(by), ["k1", "k2"], ["hot", "n"], 0.9 * least / ratio

    def side(df: DataFrame) -> DataFrame:
        own = df.where(F.size("strings") >= 2).withColumn("strings", F.array_sort(F.array_distinct("strings")))
        return own.select(*by, "id", "ord", "strings", F.xxhash64("strings").alias("k1"), F.xxhash64(F.lit(7), "strings").alias("k2"))

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.select(*by, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by))

    a, b = side(t), side(r)
    sets = [settled(df.groupBy(*by, *key).agg(F.first("strings").alias("strings")), "sets") for df in (a, b)]  # read several times below
    each = [df.select(*by, *key, F.explode("strings").alias("member")) for df in sets]
    hot = settled(hot_members(each, by), "hot")
    profiles = []
    for df, members in zip(sets, each, strict=True):
        own = members.join(hot, [*by, "member"]).groupBy(*by, *key).agg(F.array_sort(F.collect_list("member")).alias("hot"))
        rows = df.select(*by, *key, F.size("strings").alias("n")).join(own, [*by, *key], "left")
        profiles.append(settled(rows.withColumn("hot", F.coalesce("hot", F.array().cast("array<string>"))), "profiles"))
    (ta, rb), out = (named(df, p) for df, p in zip(profiles, "tr", strict=True)), [*by, "t_k1", "t_k2", "r_id", "r_ord", "score"]
    both = F.size(F.array_intersect("t_hot", "r_hot"))
    score = lambda shared: shared / (F.col("t_n") + F.col("r_n") - shared)

    cold = [named(df.join(hot, [*by, "member"], "left_anti"), p).withColumnRenamed(f"{p}_member", "member") for df, p in zip(each, "tr", strict=True)]
    pairs = cold[0].join(cold[1], [*by, "member"]).groupBy(*by, "t_k1", "t_k2", "r_k1", "r_k2").agg(F.count(F.lit(1)).alias("shared"))
    met = pairs.join(ta, [*by, "t_k1", "t_k2"]).join(rb, [*by, "r_k1", "r_k2"]).withColumn("score", score(F.col("shared") + both)).where(F.col("score") >= floor)
    first = Window.partitionBy(*by, *key).orderBy("ord")
    two = named(b.select(*by, *key, "id", "ord", F.row_number().over(first).alias("k")).where("k <= 2").drop("k"), "r")
    alike = met.select(*by, "t_k1", "t_k2", "r_k1", "r_k2", "score").join(two, [*by, "r_k1", "r_k2"]).select(*out)

    # profiles that can reach the floor at all
    able = (F.size("hot") > 0) & (F.size("hot") / F.col("n") >= floor)
    some = two.select(*by, F.col("r_k1").alias("k1"), F.col("r_k2").alias("k2"), F.col("r_id").alias("id"), F.col("r_ord").alias("ord")).join(profiles[1].where(able), [*by, *key])
    first = Window.partitionBy(*by, *profile).orderBy("ord")
    some = named(some.select(*by, *profile, "id", "ord", F.row_number().over(first).alias("k")).where("k <= 2").drop("k"), "r")
    tp, rp = (named(df.where(able).select(*by, *profile).distinct(), p).withColumn("member", F.explode(f"{p}_hot")) for df, p in zip(profiles, "tr", strict=True))
    near = (F.least(F.size("t_hot"), F.size("r_hot")) >= floor * F.greatest("t_n", "r_n")) & (F.element_at(F.array_intersect("t_hot", "r_hot"), 1) == F.col("member"))
    stand = tp.join(rp, [*by, "member"]).where(near).withColumn("score", score(both)).where(F.col("score") >= floor).drop("member").join(some, [*by, "r_hot", "r_n"])
    best = Window.partitionBy(*by, "t_hot", "t_n").orderBy(F.desc("score"), "r_ord")
    stand = stand.withColumn("k", F.row_number().over(best)).where("k <= 2").select(*by, "t_hot", "t_n", "r_id", "r_ord", "score")
    plain = ta.join(stand, [*by, "t_hot", "t_n"]).select(*out)

    found = alike.union(plain).groupBy(*out[:-1]).agg(F.max("score").alias("score")).withColumn("t_id", F.struct(F.col("t_k1").alias("k1"), F.col("t_k2").alias("k2")))
    won = gate(top_two(found, by), least, ratio).select(*by, F.col("t_k1").alias("k1"), F.col("t_k2").alias("k2"), "r_id", "r_ord", "score", "second")
    return a.select(*by, *key, F.col("id").alias("t_id"), F.col("ord").alias("t_ord")).join(won, [*by, *key]).drop(*key)


def string_seeds(t: DataFrame, r: DataFrame, by: Sequence[str] = (), least: float = 0.15, ratio: float = 1.3) -> DataFrame:
    """First technique: ``(*by, t_id, t_ord, r_id, r_ord, confidence, technique)``."""
    best = best_seeds(t, r, by, least, ratio)
    return assign(best, by).where("rank = 1").select(*by, "t_id", "t_ord", "r_id", "r_ord", F.col("score").alias("confidence"), F.lit("string_seed").alias("technique"))


def seed_acceptances(t: DataFrame, r: DataFrame, by: Sequence[str] = (), least: float = 0.15, ratio: float = 1.3) -> DataFrame:
    """How many seeds were accepted, kept and evicted."""
    best = best_seeds(t, r, by, least, ratio)
    return assign(best, by).groupBy(*by).agg(F.count_if("held").alias("accepted"), F.count_if(F.col("rank") == 1).alias("kept"))


def _blocks(low: Column, high: Column) -> Column:
    """The aligned blocks ``(level, block)`` of ``2 ** level`` whole numbers that make up ``low`` to ``high``, two a level at most."""

    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        left, right = F.floor((low + width - 1) / width), F.floor((high + 1) / width)
        take = lambda end, block: F.when((left < right) & (end % 2 == 1), F.struct(k.alias("level"), block.alias("block")))
        return F.array(take(left, left), take(right, right - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(high))), at)))


def structure_scores(t: DataFrame, r: DataFrame, by: Sequence[str] = (), least_features: int = 3, floor: float = 0.10 / 1.3) -> DataFrame:
    """``(*by, t_id, t_ord, r_id, r_ord, score)`` for the fourth technique: Jaccard of string prefixes plus
    boosts for equal structure; all pairs that can be a target's best or its runner-up.

    Pairs that share a prefix of few modules are formed from it.  Any other pair shares a set of hot prefixes alone, often
    the empty one.  Of the references that have such a set, those with the fewest prefixes score best, whatever
    the target is; so for each combination of boosts a target needs the first two references, by number of prefixes and
    order, among those of its count, kind and near size.  Sizes near to a target's are an interval, made up of aligned
    blocks, each of which keeps its first two.  Boosts alone under ``floor`` neither pass the gate nor block a score that does.
    """
    by, name = list(by), ["s1", "s2"]
    features = F.array_distinct(F.transform(F.filter("strings", lambda s: F.length(s) >= 6), lambda s: F.substring(s, 1, 30)))
    out = [*by, "t_id", "t_ord", "r_id", "r_ord", "score"]

    def side(df: DataFrame, p: str) -> DataFrame:
        rows = df.withColumn("features", features).where(F.size("features") >= least_features)
        rows = rows.select(*by, F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"), "features", F.size("features").alias(f"{p}_size"), F.col("stmtCount").alias(f"{p}_n"), F.col("wrapKind").alias(f"{p}_kind"), F.col("bytes").alias(f"{p}_bytes"))
        return settled(rows, "features")  # read several times below

    sides = {p: side(df, p) for p, df in (("t", t), ("r", r))}
    each = {p: df.select(*by, f"{p}_id", F.explode("features").alias("member")) for p, df in sides.items()}
    hot = settled(hot_members([df.select(*by, "member") for df in each.values()], by), "hot")

    def profiled(p: str) -> DataFrame:
        own = each[p].join(hot, [*by, "member"]).groupBy(*by, f"{p}_id").agg(F.array_sort(F.collect_list("member")).alias(f"{p}_hot"))
        rows = sides[p].drop("features").join(own, [*by, f"{p}_id"], "left")
        return settled(rows.withColumn(f"{p}_hot", F.coalesce(f"{p}_hot", F.array().cast("array<string>"))), "profiles")

    a, b = profiled("t"), profiled("r")
    close = (F.col("t_bytes") > 0) & (F.col("r_bytes") > 0) & (F.abs(F.col("t_bytes") - F.col("r_bytes")) / F.greatest("t_bytes", "r_bytes", F.lit(1)) < 0.3)
    boost = F.when(F.col("t_n") == F.col("r_n"), 0.05).otherwise(0.0) + F.when(F.col("t_kind") == F.col("r_kind"), 0.03).otherwise(0.0) + F.when(close, 0.05).otherwise(0.0)
    score = lambda shared: shared / (F.col("t_size") + F.col("r_size") - shared) + boost

    cold = [each[p].join(hot, [*by, "member"], "left_anti") for p in "tr"]
    shared = cold[0].join(cold[1], [*by, "member"]).groupBy(*by, "t_id", "r_id").agg(F.count(F.lit(1)).alias("shared"))
    alike = shared.join(a, [*by, "t_id"]).join(b, [*by, "r_id"]).withColumn("score", score(F.col("shared") + F.size(F.array_intersect("t_hot", "r_hot")))).select(*out)

    # the sets of hot prefixes that some target and some reference have in common, and who has them
    have = {p: df.where(F.size(f"{p}_hot") > 0).select(*by, f"{p}_hot").distinct() for p, df in (("t", a), ("r", b))}
    met = have["t"].withColumn("member", F.explode("t_hot")).join(have["r"].withColumn("member", F.explode("r_hot")), [*by, "member"]).where(F.element_at(F.array_intersect("t_hot", "r_hot"), 1) == F.col("member"))
    met = settled(met.select(*by, "t_hot", "r_hot", F.array_intersect("t_hot", "r_hot").alias("common")).select(*by, "t_hot", "r_hot", F.xxhash64("common").alias("s1"), F.xxhash64(F.lit(7), "common").alias("s2"), F.size("common").alias("n")), "common")

    def placed(df: DataFrame, p: str) -> DataFrame:
        none = df.select("*", F.lit(0).cast("long").alias("s1"), F.lit(0).cast("long").alias("s2"), F.lit(0).alias("n"))
        some = df.join(met.select(*by, f"{p}_hot", *name, "n").distinct(), [*by, f"{p}_hot"]).select(*none.columns)
        return none.union(some).drop(f"{p}_hot").withColumn("rank", F.when(F.col("n") > 0, F.col(f"{p}_size")).otherwise(0))

    x, y = placed(a, "t"), placed(b, "r").drop("n")
    size = F.col("t_bytes").cast("long")
    # the interval by the very comparison of ``close``, so that rounding agrees
    low = F.element_at(F.filter(F.sequence(F.floor(size * 0.7) - 1, F.floor(size * 0.7) + 2), lambda v: (v > 0) & ((size - v) / F.greatest(size, F.lit(1)) < 0.3)), 1)
    high = F.array_max(F.filter(F.sequence(F.floor(size / 0.7) - 2, F.floor(size / 0.7) + 2), lambda v: (v > 0) & ((v - size) / F.greatest(v, F.lit(1)) < 0.3)))
    wide = x.where("t_bytes > 0").withColumns({"low": low, "high": high}).withColumn("z", F.explode(_blocks(F.col("low"), F.col("high")))).select(*x.columns, "z.level", "z.block")
    length = F.col("r_bytes").cast("long")
    level = y.where("r_bytes > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.length(F.bin(length))))).withColumn("block", F.floor(length / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))))

    def first(left: DataFrame, right: DataFrame, near: bool, *equal: str) -> DataFrame:
        """Candidates among the references of equal count or kind, near in size or not."""
        keys = [*by, *name, *(("level", "block") if near else ())]
        if 0.05 * ("n" in equal) + 0.03 * ("kind" in equal) + 0.05 * near < floor:
            left, right = left.where("n > 0"), right.where("s1 <> 0 or s2 <> 0")
        rights = right.select(*keys, *(F.col(f"r_{k}").alias(f"of_{k}") for k in equal), "rank", *(f"r_{c}" for c in ("id", "ord", "size", "n", "kind", "bytes")))
        on = [*keys, *(f"of_{k}" for k in equal)]
        two = rights.withColumn("k", F.row_number().over(Window.partitionBy(*on).orderBy("rank", "r_ord"))).where("k <= 2").drop("k", "rank")
        lefts = left.select(*keys, *(F.col(f"t_{k}").alias(f"of_{k}") for k in equal), F.col("n").alias("shared"), *(f"t_{c}" for c in ("id", "ord", "size", "n", "kind", "bytes")))
        return lefts.join(two, on).withColumn("score", score(F.col("shared"))).where(F.col("score") >= floor).select(*out)

    found = alike
    for equal in ((), ("n",), ("kind",), ("n", "kind")):
        found = found.union(first(x, y, False, *equal)).union(first(wide, level, True, *equal))
    return found.groupBy(*out[:-1]).agg(F.max("score").alias("score"))

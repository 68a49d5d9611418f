"""Name propagation, closure, degrees and hubs over ``edges(bkg_id, src, dst)``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import settled


def degrees(edges: DataFrame, key: str = "bkg_id") -> DataFrame:
    """``(bkg_id, id, fan_out, fan_in)``: one shuffle of the edges' ends."""
    ends = edges.select(key, F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(key, "e.id").agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))


def hubs(edges: DataFrame, n: int = 10, key: str = "bkg_id") -> DataFrame:
    """The ``n`` nodes of each graph that most others depend on; ties to the smaller id."""
    w = Window.partitionBy(key).orderBy(F.desc("fan_in"), "id")
    return degrees(edges, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def totals(edges: DataFrame, definitions: DataFrame, key: str = "bkg_id") -> DataFrame:
    """``(bkg_id, total_edges, top_level_names)`` from edges and ``definitions(bkg_id, name)``; graphs without edges have 0."""
    n = edges.groupBy(key).agg(F.count(F.lit(1)).alias("total_edges"))
    names = definitions.groupBy(key).agg(F.count_distinct("name").alias("top_level_names"))
    both = names.join(n, key, "full_outer")
    return both.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_edges", "top_level_names")))


def closure(edges: DataFrame, starts: DataFrame, key: str = "bkg_id", max_depth: int | None = None) -> DataFrame:
    """``(bkg_id, start, id, depth)``: everything that ``starts(bkg_id, start)`` reach, breadth first, to the end or to a depth."""
    reached = front = settled(starts.select(key, "start", F.col("start").alias("id"), F.lit(0).alias("depth")), "reach")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.select(key, "start", F.col("id").alias("src")).join(edges.select(key, "src", F.col("dst").alias("id")), [key, "src"]).select(key, "start", "id").distinct()
        front = settled(step.join(reached.select(key, "start", "id"), [key, "start", "id"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        reached = reached.union(front)
    return reached


def propagate_rounds(modules: DataFrame, edges: DataFrame, rounds: int = 10, ratio: float = 0.4, key: str = "bkg_id") -> DataFrame:
    """Synchronous propagation: each round names unnamed modules from the names of the round before.

    ``modules``: key, id, ord, semantic_name, semantic_confidence, semantic_source, strings.
    The named neighbour with most dependants (its own fan-in) gives the name; outgoing neighbours come before incoming ones,
    then their order in the edge list (``pos``, else id).
    """
    pos = F.col("pos") if "pos" in edges.columns else F.lit(0)
    out = edges.select(key, F.col("src").alias("id"), F.col("dst").alias("near"), F.lit(0).alias("side"), pos.alias("pos"))
    into = edges.select(key, F.col("dst").alias("id"), F.col("src").alias("near"), F.lit(1).alias("side"), pos.alias("pos"))
    around = settled(out.union(into), "around")
    total = around.groupBy(key, "id").agg(F.count(F.lit(1)).alias("deg"))
    fan = edges.groupBy(key, F.col("dst").alias("near")).agg(F.count(F.lit(1)).alias("fan_in"))
    now = settled(modules.join(total, [key, "id"], "left").withColumn("deg", F.coalesce("deg", F.lit(0))), "names")
    for _ in range(rounds):
        named = now.where("semantic_name <> ''").select(key, F.col("id").alias("near"), F.col("semantic_name").alias("name"))
        seen = around.join(named, [key, "near"]).join(fan, [key, "near"], "left")
        best = F.min(F.struct(-F.coalesce("fan_in", F.lit(0)), "side", "pos", "near", "name")).alias("best")
        votes = seen.groupBy(key, "id").agg(F.count(F.lit(1)).alias("n_named"), best)
        able = (F.coalesce("semantic_name", F.lit("")) == "") & (F.col("n_named") / F.col("deg") >= ratio) & ((F.col("deg") >= 2) | (F.size("strings") > 0))
        name = F.concat(F.lit("near_"), F.regexp_replace("best.name", "^near_", ""))
        joined = now.join(votes, [key, "id"], "left").withColumn("hit", F.coalesce(able, F.lit(False)))
        step = joined.select(
            *(c for c in now.columns if not c.startswith("semantic_")), F.when(F.col("hit"), name).otherwise(F.col("semantic_name")).alias("semantic_name"),
            F.when(F.col("hit"), F.least(F.lit(0.6), F.col("n_named") / F.col("deg") * 0.7)).otherwise(F.col("semantic_confidence")).alias("semantic_confidence"),
            F.when(F.col("hit"), F.lit("propagation")).otherwise(F.col("semantic_source")).alias("semantic_source"), "hit",
        )
        step = settled(step, "names")
        now = step.drop("hit")
        if step.where("hit").isEmpty():
            break
    return now.drop("deg")


def propagate_in_order(ids: list, names: dict, strings: dict, deps_out: dict, deps_in: dict, rounds: int = 10, ratio: float = 0.4) -> dict:
    """Sequential propagation in one graph: names given earlier in a pass count for later modules.

    Returns ``{id: (name, confidence)}`` of the modules named here.
    """
    names, given = dict(names), {}
    for _ in range(rounds):
        changed = False
        for i in ids:
            if names.get(i):
                continue
            near = [n for n in (*deps_out.get(i, ()), *deps_in.get(i, ())) if names.get(n)]
            deg = len(deps_out.get(i, ())) + len(deps_in.get(i, ()))
            if not near or len(near) / deg < ratio or deg < 2 and not strings.get(i):
                continue
            first = max(near, key=lambda n: len(deps_in.get(n, ())))  # the first of the largest
            names[i] = "near_" + names[first].removeprefix("near_")
            given[i] = (names[i], min(0.6, len(near) / deg * 0.7))
            changed = True
        if not changed:
            break
    return given


def propagate(modules: DataFrame, key: str = "bkg_id") -> DataFrame:
    """Exact (sequential) propagation, one task per graph: module ids and names only go to Python."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        out, into = ({i: list(d) if d is not None else [] for i, d in zip(pdf["id"], pdf[c], strict=True)} for c in ("deps_out", "deps_in"))
        given = propagate_in_order(list(pdf["id"]), dict(zip(pdf["id"], pdf["semantic_name"], strict=True)), dict(zip(pdf["id"], pdf["n_strings"], strict=True)), out, into)
        return pd.DataFrame([(pdf[key].iloc[0], i, n, c) for i, (n, c) in given.items()], columns=[key, "id", "given", "certainty"])

    slim = modules.select(key, "id", "ord", "semantic_name", F.size("strings").alias("n_strings"), "deps_out", "deps_in")
    kind = modules.schema[key].dataType.simpleString()
    given = slim.groupBy(key).applyInPandas(run, f"{key} {kind}, id string, given string, certainty double")
    hit = F.col("given").isNotNull()
    named = modules.join(given, [key, "id"], "left")
    return named.withColumns({"semantic_name": F.coalesce("given", "semantic_name"), "semantic_confidence": F.when(hit, F.col("certainty")).otherwise(F.col("semantic_confidence")), "semantic_source": F.when(hit, F.lit("propagation")).otherwise(F.col("semantic_source"))}).drop("given", "certainty")

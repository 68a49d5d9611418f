"""Matching the modules of two graphs: a cascade of four techniques.

``cascade`` is set-oriented and synchronous: each round or technique sees the matches made before
it, and the first target wins a contested reference.  ``match_in_order`` is sequential: targets in order
see all earlier matches; :func:`cascade_exact` runs it per pair of graphs.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.similarity import fingerprint_similarity, gate, string_seeds, structure_scores, top_two
from graphloom.sources.tables import settled

COLUMNS = ("t_id", "t_ord", "r_id", "r_ord", "confidence", "technique")


def _edges(modules: DataFrame) -> DataFrame:
    """Adjacency as given on both sides: ``(id, near, out)``."""
    out = modules.select("id", F.explode("deps_out").alias("near"), F.lit(True).alias("out"))
    return out.union(modules.select("id", F.explode("deps_in").alias("near"), F.lit(False).alias("out")))


def _first_claim(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("r_id").orderBy("t_ord")
    return rows.withColumn("claim", F.row_number().over(w)).where("claim = 1").drop("claim")


def neighbour_round(t: DataFrame, r: DataFrame, te: DataFrame, re: DataFrame, matches: DataFrame) -> DataFrame:
    """One round of the second technique: candidates are neighbours of the neighbours' matches."""
    mine = matches.select(F.col("t_id").alias("near"), F.col("r_id").alias("r_near"))
    seen = te.join(mine, "near").join(matches.select(F.col("t_id").alias("id")), "id", "left_anti")
    total = seen.groupBy("id").agg(F.count(F.lit(1)).alias("matched"))
    # a dependency's match points back along deps_in, a dependant's along deps_out
    back = re.select(F.col("id").alias("r_near"), F.col("near").alias("r_id"), (~F.col("out")).alias("out"))
    votes = seen.join(back, ["r_near", "out"]).join(matches.select("r_id"), "r_id", "left_anti").groupBy("id", "r_id").agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "r_id")
    best = votes.withColumn("rank", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0))).where("rank = 1 and score >= 2 and score > second")
    full = best.join(total, "id").join(t.select("id", F.col("ord").alias("t_ord"), F.col("ast_fingerprint").alias("fa")), "id").join(r.select(F.col("id").alias("r_id"), F.col("ord").alias("r_ord"), F.col("ast_fingerprint").alias("fb")), "r_id")
    confidence = F.least(F.lit(0.95), F.lit(0.5) + F.col("score") / F.col("matched") * 0.3 + fingerprint_similarity(F.col("fa"), F.col("fb")) * 0.3)
    return _first_claim(full.select(F.col("id").alias("t_id"), "t_ord", "r_id", "r_ord", confidence.alias("confidence"), F.lit("graph_propagation").alias("technique")))


def _open(t: DataFrame, r: DataFrame, te: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unmatched targets with a matched neighbour, and free references."""
    beside = te.join(matches.select(F.col("t_id").alias("near")), "near", "left_semi").select("id").distinct()
    left = t.join(matches.select(F.col("t_id").alias("id")), "id", "left_anti").join(beside, "id", "left_semi")
    return left, r.join(matches.select(F.col("r_id").alias("id")), "id", "left_anti")


def alike_shapes(ka: DataFrame, kb: DataFrame, least: float = 0.58) -> DataFrame:
    """``(t_kinds, t_len, r_kinds, r_len, score)`` of the shapes whose similarity is at least ``least``.

    Similar shapes are near in length and share that part of the larger set of kinds, hence one of the rarest kinds of
    each: they meet on the class of the length and such a kind, the first that they have in common.
    """
    by = {p: [f"{p}_kinds", f"{p}_len"] for p in "tr"}
    # lengths within ``least`` of each other lie in the same or neighbouring classes of a base of at least its inverse
    level = lambda c: F.floor(F.log(c) / F.log(F.lit(1.05 / least)))
    each = {p: df.select(*by[p], F.explode(f"{p}_kinds").alias("kind")) for p, df in (("t", ka), ("r", kb))}
    seen = each["t"].select("kind").union(each["r"].select("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))

    def rare(p: str) -> DataFrame:
        rows = each[p].join(seen, "kind").groupBy(*by[p]).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "kind"))), lambda x: x["kind"]).alias("k"))
        size = F.size("k")
        # slightly below the exact share, so that rounding loses nothing
        first = F.slice("k", 1, (size - F.ceil(size * (least - 1e-9)) + 1).cast("int"))
        return rows.select(*by[p], first.alias(f"{p}_first")).withColumn("kind", F.explode(f"{p}_first"))

    a = rare("t").withColumn("c", F.explode(F.array(*(level(F.col("t_len")) + k for k in (-1, 0, 1)))))
    met = a.join(rare("r").withColumn("c", level(F.col("r_len"))), ["c", "kind"]).where(F.element_at(F.array_intersect("t_first", "r_first"), 1) == F.col("kind"))
    common = F.size(F.array_intersect("t_kinds", "r_kinds")) / F.greatest(F.size("t_kinds"), F.size("r_kinds"))
    return met.select(*by["t"], *by["r"], (common * (F.least("t_len", "r_len") / F.greatest("t_len", "r_len"))).alias("score")).where(F.col("score") >= least)


def fingerprint_round(t: DataFrame, r: DataFrame, te: DataFrame, matches: DataFrame) -> DataFrame:
    """Third technique.  Similarity depends on the set of kinds and the length only, so both sides are
    grouped by these; pairs of shapes are kept when they could matter (0.7 / 1.2)."""
    left, free = _open(t, r, te, matches)
    shape = lambda df, p: df.where("ast_fingerprint <> ''").select(F.col("id").alias(f"{p}_id"), F.col("ord").alias(f"{p}_ord"), F.array_sort(F.array_distinct(F.split("ast_fingerprint", ":"))).alias(f"{p}_kinds"), F.size(F.split("ast_fingerprint", ":")).alias(f"{p}_len"))
    a, b = settled(shape(left, "t").where("t_len >= 5"), "shapes"), settled(shape(free, "r"), "shapes")  # read several times below
    ka, kb = (x.select(f"{p}_kinds", f"{p}_len").distinct() for x, p in ((a, "t"), (b, "r")))
    scored = alike_shapes(ka, kb)
    # the two first references of a shape decide for every target of a like shape, and two of them for each shape of targets
    first = Window.partitionBy("r_kinds", "r_len").orderBy("r_ord")
    some = b.withColumn("k", F.row_number().over(first)).where("k <= 2").drop("k")
    order = Window.partitionBy("t_kinds", "t_len").orderBy(F.desc("score"), "r_ord")
    stand = scored.join(some, ["r_kinds", "r_len"]).withColumn("k", F.row_number().over(order)).where("k <= 2").select("t_kinds", "t_len", "r_id", "r_ord", "score")
    best = gate(top_two(a.join(stand, ["t_kinds", "t_len"])), 0.7, 1.2)
    return _first_claim(best.select("t_id", "t_ord", "r_id", "r_ord", (F.col("score") * 0.8).alias("confidence"), F.lit("ast_fingerprint").alias("technique")))


def structure_round(t: DataFrame, r: DataFrame, te: DataFrame, matches: DataFrame) -> DataFrame:
    """Fourth technique."""
    left, free = _open(t, r, te, matches)
    best = gate(top_two(structure_scores(left, free)), 0.10, 1.3)
    return _first_claim(best.select("t_id", "t_ord", "r_id", "r_ord", F.least(F.lit(0.85), F.col("score") + 0.3).alias("confidence"), F.lit("identifier_fingerprint").alias("technique")))


def cascade(t: DataFrame, r: DataFrame, rounds: int = 20) -> DataFrame:
    """All matches of two module tables: ``t_id, t_ord, r_id, r_ord, confidence, technique``."""
    te, re = settled(_edges(t), "edges"), settled(_edges(r), "edges")
    matches = settled(string_seeds(t, r).select(*COLUMNS), "matches")
    for _ in range(rounds):
        more = settled(neighbour_round(t, r, te, re, matches).select(*COLUMNS), "round")
        if more.isEmpty():
            break
        matches = matches.union(more)
    matches = settled(matches, "matches")
    matches = settled(matches.union(fingerprint_round(t, r, te, matches).select(*COLUMNS)), "matches")
    return settled(matches.union(structure_round(t, r, te, matches).select(*COLUMNS)), "matches")


def transfer(t: DataFrame, r: DataFrame, matches: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Targets with the names of their matches."""
    key = key or []
    name = F.when(F.coalesce("semantic_name", F.lit("")) != "", F.col("semantic_name")).otherwise(F.col("minified_name"))
    known = r.select(*key, F.col("id").alias("r_id"), name.alias("__name"), F.nullif("source_file", F.lit("")).alias("__file"))
    found = matches.select(*key, F.col("t_id").alias("id"), "r_id", "confidence", "technique").join(known, [*key, "r_id"])
    hit = F.col("technique").isNotNull()
    joined = t.join(found, [*key, "id"], "left")
    return joined.withColumns({
        "semantic_name": F.when(hit, F.col("__name")).otherwise(F.col("semantic_name")), "semantic_confidence": F.when(hit, F.col("confidence")).otherwise(F.col("semantic_confidence")),
        "semantic_source": F.when(hit, F.concat(F.lit("cross_version_match:"), "technique")).otherwise(F.col("semantic_source")), "source_file": F.coalesce("__file", "source_file"),
    }).select(*t.columns)


# -- sequential


def _similar(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    x, y = a.split(":"), b.split(":")
    sx, sy = set(x), set(y)
    return len(sx & sy) / max(len(sx), len(sy)) * (min(len(x), len(y)) / max(len(x), len(y)))


def _leader(scores: list[tuple[float, str]], least: float, ratio: float) -> tuple[float, str] | None:
    """The first best, if good enough and clear of the second."""
    scores = sorted((s for s in scores if s[0] > 0), key=lambda s: -s[0])
    if not scores or scores[0][0] < least or len(scores) > 1 and scores[0][0] < scores[1][0] * ratio:
        return None
    return scores[0]


def match_in_order(target: list[dict], ref: list[dict], rounds: int = 20) -> list[tuple[str, str, float, str]]:
    """All four techniques over module dicts in order: ``(t_id, r_id, confidence, technique)``."""
    refs = {m["id"]: m for m in ref}
    found: dict[str, tuple[str, float, str]] = {}
    taken: dict[str, str] = {}

    def keep(t: str, r: str, c: float, how: str) -> None:
        found[t], taken[r] = (r, c, how), t

    where = defaultdict(list)
    sizes = {m["id"]: len(set(m["strings"])) for m in ref if len(m["strings"]) >= 2}
    place = {m["id"]: k for k, m in enumerate(ref)}
    for m in ref:
        for s in set(m["strings"]) if m["id"] in sizes else ():
            where[s].append(m["id"])
    for m in target:
        if len(m["strings"]) < 2:
            continue
        own, shared = set(m["strings"]), defaultdict(int)
        for s in own:
            for r in where.get(s, ()):
                shared[r] += 1
        best = _leader([(n / (len(own) + sizes[r] - n), r) for r, n in sorted(shared.items(), key=lambda x: place[x[0]])], 0.15, 1.3)
        if best and (best[1] not in taken or best[0] > found[taken[best[1]]][1]):
            if best[1] in taken:
                del found[taken[best[1]]]
            keep(m["id"], best[1], best[0], "string_seed")
    for _ in range(rounds):
        changed = False
        for m in target:
            if m["id"] in found:
                continue
            sides = [(d, "deps_in") for d in m["deps_out"] if d in found] + [(d, "deps_out") for d in m["deps_in"] if d in found]
            votes: dict[str, int] = defaultdict(int)
            for d, back in sides:
                for r in refs.get(found[d][0], {}).get(back, ()):
                    if r not in taken:
                        votes[r] += 1
            order = sorted(votes.items(), key=lambda x: -x[1])
            if order and order[0][1] >= 2 and (len(order) == 1 or order[0][1] > order[1][1]):
                r, n = order[0]
                same = _similar(m["ast_fingerprint"], refs.get(r, {}).get("ast_fingerprint"))
                keep(m["id"], r, min(0.95, 0.5 + n / len(sides) * 0.3 + same * 0.3), "graph_propagation")
                changed = True
        if not changed:
            break
    beside = lambda m: any(d in found for d in (*m["deps_out"], *m["deps_in"]))
    for m in target:
        if m["id"] not in found and len((m["ast_fingerprint"] or "").split(":")) >= 5 and beside(m):
            if best := _leader([(_similar(m["ast_fingerprint"], x["ast_fingerprint"]), x["id"]) for x in ref if x["id"] not in taken], 0.7, 1.2):
                keep(m["id"], best[1], best[0] * 0.8, "ast_fingerprint")
    marks = lambda m: {s[:30] for s in m["strings"] if len(s) >= 6}
    held = [(x, f) for x in ref if len(f := marks(x)) >= 3]
    for m in target:
        if m["id"] in found or len(f := marks(m)) < 3 or not beside(m):
            continue
        scores = []
        for x, g in held:
            if x["id"] in taken:
                continue
            score = len(f & g) / len(f | g)
            a, b = m["bytes"], x["bytes"]
            boost = 0.05 * (m["stmtCount"] == x["stmtCount"])
            boost += 0.03 * (m["wrapKind"] == x["wrapKind"])
            boost += 0.05 * (a > 0 and b > 0 and abs(a - b) / max(a, b) < 0.3)
            scores.append((score + boost, x["id"]))
        if best := _leader(scores, 0.10, 1.3):
            keep(m["id"], best[1], min(0.85, best[0] + 0.3), "identifier_fingerprint")
    return [(t, *x) for t, x in found.items()]


def cascade_exact(t: DataFrame, r: DataFrame, key: str = "pair") -> DataFrame:
    """``(pair, t_id, r_id, confidence, technique)``: sequential matching, one task per pair of graphs."""
    fields = ["id", "ord", "strings", "deps_out", "deps_in", "ast_fingerprint", "stmtCount", "wrapKind", "bytes"]

    def dicts(pdf: pd.DataFrame) -> list[dict]:
        if pdf.empty:  # the other side alone has this pair
            return []
        rows = pdf.sort_values("ord")[fields].to_dict("records")
        return [{k: (list(v) if v is not None else []) if k in ("strings", "deps_out", "deps_in") else v for k, v in x.items()} for x in rows]

    def run(key_value, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key_value[0], *x) for x in match_in_order(dicts(a), dicts(b))], columns=[key, "t_id", "r_id", "confidence", "technique"])

    kind = t.schema[key].dataType.simpleString()
    # new names for the columns: two sides from one table would lose those they share
    side = lambda df: df.select(*(F.col(c).alias(c) for c in (key, *fields))).groupBy(key)
    return side(t).cogroup(side(r)).applyInPandas(run, f"{key} {kind}, t_id string, r_id string, confidence double, technique string")

"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to).  A flow
routes word capacity from patterns to source quotas; the r-th repetition of a pattern costs more
than the one before (convex), so repeats are used only where quotas demand them.  The flow fixes
how many words each pattern gives; a seeded hash then picks the documents: all of a pattern in
the whole repetitions, and those below an exact cut of the hash in the last one.

The cut is found by two pre-aggregated histograms of the hash, never by sorting a source.  The driver holds
one row for each pattern; flows are solved for each group of patterns that share sources.

Defined results: null text has size 0; null sources form a source of their own, last; empty
documents take 0 words; rows that repeat an id, or a text where the id is null, are separate documents but are taken alike; an empty table
gives an empty result; columns of any name may be there.  More than ``max_patterns`` patterns are refused with ``ValueError``.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import discard, n_words, written

#: Buckets of each histogram level.
FINE = 1024


def water_fill(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets that add up to ``share`` of all sizes by weight, none above ``cap`` times its size."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        scale = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if scale * weights[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                out[i] = scale * weights[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= full
    return out


def min_cost_flow(capacity: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, dict]:
    """Words each pattern gives each of its sources: ``{pattern: {source: words}}``.

    Successive shortest paths with potentials.  Every pattern has ``repeats`` parallel arcs of its
    capacity with costs 0, 1, 2, ...; sources pass on at most their quota.
    """
    nodes: dict = {"s": 0, "t": 1}
    graph: list[list[int]] = [[], []]
    to: list[int] = []
    room: list[float] = []
    cost: list[int] = []

    def node(x):
        if x not in nodes:
            nodes[x] = len(graph)
            graph.append([])
        return nodes[x]

    def arc(a, b, c, w):
        for x, y, r, k in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(k)

    links = []
    for p, c in sorted(capacity.items(), key=lambda x: str(x[0])):
        for r in range(repeats):
            arc(0, node(("p", p)), c, r)
        for s in p:
            links.append((p, s, len(to)))
            arc(node(("p", p)), node(("s", s)), c * repeats, 0)
    for s, q in quota.items():
        arc(node(("s", s)), 1, int(round(q)), 0)
    n = len(graph)
    pot = [0] * n
    while True:
        dist, via, heap = [float("inf")] * n, [-1] * n, [(0, 0)]
        dist[0] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if room[e] > 0 and (x := d + cost[e] + pot[u] - pot[to[e]]) < dist[to[e]]:
                    dist[to[e]], via[to[e]] = x, e
                    heapq.heappush(heap, (x, to[e]))
        if via[1] < 0:
            break
        pot = [p + (d if d < float("inf") else 0) for p, d in zip(pot, dist, strict=True)]
        path, u = [], 1
        while u:
            path.append(via[u])
            u = to[via[u] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow
    out: dict[tuple, dict] = defaultdict(dict)
    for p, s, e in links:
        out[p][s] = room[e ^ 1]
    return out


def routed(capacity: dict[tuple, int], quota: dict, repeats: int) -> dict[tuple, int]:
    """Words that each pattern gives, by :func:`min_cost_flow` over each group of patterns that share sources.

    A pattern alone with its one source gives what the source takes; no flow is needed for it.
    """
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for p in capacity:
        for a in p[1:]:
            root[find(("s", a))] = find(("s", p[0]))
    groups: dict = defaultdict(list)
    for p in capacity:
        if p:
            groups[find(("s", p[0]))].append(p)
    out = dict.fromkeys(capacity, 0)
    for group in groups.values():
        if len(group) == 1 and len(group[0]) == 1:
            p = group[0]
            out[p] = min(int(round(quota[p[0]])), capacity[p] * repeats)
        else:
            some = {s for p in group for s in p}
            for p, f in min_cost_flow({p: capacity[p] for p in group}, {s: q for s, q in quota.items() if s in some}, repeats).items():
                out[p] = int(sum(f.values()))
    return out


def last_buckets(level: DataFrame, want: dict[str, int], bucket: str) -> dict[str, tuple[int, int, int]]:
    """For each pattern's words wanted: the bucket of ``level(__p, <bucket>, n)`` in which they end, how many fall in it, its size."""
    wanted = level.sparkSession.createDataFrame(list(want.items()), "__p string, rest long")
    upto = F.sum("n").over(Window.partitionBy("__p").orderBy(bucket))  # FINE rows in a group at most
    ends = level.join(F.broadcast(wanted), "__p").withColumn("upto", upto).where("upto > rest")
    found = ends.groupBy("__p").agg(F.min(F.struct(bucket, (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), "n")).alias("x")).collect()
    return {r["__p"]: tuple(r["x"]) for r in found}


def planned(docs: DataFrame, members: Column, weigh, id_col: str = "doc_id", text_col: str = "text", share: float = 1.5, repeats: int = 2, seed: int = 17, max_patterns: int = 100_000) -> DataFrame:
    """``(row, size, pattern, taken, source_size, target)``: the input row as a struct, what the mix takes
    of it and, for the pattern's first source, that source's figures.

    ``members``: array of the sources that a document may serve.  ``weigh``: function from the
    sorted source names to their weights.
    """
    spark = docs.sparkSession
    hash_ = F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.array_sort(F.array_distinct(members)).alias("pattern"), n_words(F.col(text_col)).alias("size"),
        F.shiftrightunsigned(hash_, 54).cast("int").alias("__b1"), (F.shiftrightunsigned(hash_, 44) % FINE).cast("int").alias("__b2"),
    ).withColumn("__p", F.to_json(F.transform("pattern", lambda x: F.coalesce(x, F.lit("\0null")))))
    slim = written(rows.select("__p", "pattern", "size", "__b1", "__b2"), "sizes")  # texts are counted here and once more in the result
    seen = slim.groupBy("__p").agg(F.first("pattern").alias("pattern"), F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(seen) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    key = {tuple(r["pattern"]): r["__p"] for r in seen}
    capacity = {tuple(r["pattern"]): r["n"] for r in seen}
    names = sorted({s for p in capacity for s in p}, key=lambda s: (s is None, s or ""))
    total = defaultdict(int)
    for p, c in capacity.items():
        for s in p:
            total[s] += c
    target = dict(zip(names, water_fill([total[s] for s in names], weigh(names), share, repeats), strict=True))
    # whole repetitions, and the words of the last, partial one
    plan = {p: divmod(n, capacity[p]) if capacity[p] else (0, 0) for p, n in routed(capacity, target, repeats).items()}
    part = {key[p]: r for p, (_, r) in plan.items() if r}
    first, second = {}, {}
    if part:
        first = last_buckets(slim.groupBy("__p", "__b1").agg(F.sum("size").alias("n")), part, "__b1")
        edge = F.broadcast(spark.createDataFrame([(k, b) for k, (b, _, _) in first.items()], "__p string, __e int"))
        inside = slim.join(edge, "__p").where("__b1 = __e")
        second = last_buckets(inside.groupBy("__p", "__b2").agg(F.sum("size").alias("n")), {k: r for k, (_, r, _) in first.items()}, "__b2")
    discard(slim)
    table = []
    for p, k in key.items():
        b1 = first[k][0] if k in first else 0
        b2, rest, n = second.get(k, (0, 0, 0))
        b2 += 2 * rest >= n > 0  # the bucket at the cut goes to the nearer side
        s = p[0] if p else None
        table.append((k, plan[p][0], b1, b2, total.get(s, 0), float(target.get(s, 0.0))))
    plans = spark.createDataFrame(table, "__p string, __whole long, __c1 long, __c2 long, source_size long, target double")  # at most max_patterns rows
    more = (F.col("__b1") < F.col("__c1")) | ((F.col("__b1") == F.col("__c1")) & (F.col("__b2") < F.col("__c2")))
    joined = rows.join(F.broadcast(plans), "__p")
    return joined.withColumn("taken", F.col("size") * (F.col("__whole") + more.cast("long"))).drop("__p", "__b1", "__b2", "__whole", "__c1", "__c2")


def mix(docs: DataFrame, members: Column, weigh, **options) -> DataFrame:
    """The input with ``size, pattern, taken, source_size, target``, which replace columns of these names."""
    own = ["size", "pattern", "taken", "source_size", "target"]
    out = planned(docs, members, weigh, **options)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in own), *own)


def by_turns(names: list) -> list[float]:
    """Weights 3, 1, 2, repeating, in the order of the names."""
    return [(3.0, 1.0, 2.0)[k % 3] for k in range(len(names))]

"""Matching, propagation, merging and recurrence on small graphs, some drawn at random."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import chain, graph, match, ops, similarity

MODULE = "id string, ord long, minified_name string, semantic_name string, semantic_confidence double, semantic_source string, source_file string, strings array<string>, ast_fingerprint string, deps_out array<string>, deps_in array<string>, stmtCount long, wrapKind string, bytes long"


def module(k, p="t", **given):
    base = {"id": f"{p}{k}", "ord": k, "minified_name": f"m{k}", "semantic_name": None, "semantic_confidence": None, "semantic_source": None, "source_file": None, "strings": [], "ast_fingerprint": None, "deps_out": [], "deps_in": [], "stmtCount": k, "wrapKind": "CJS", "bytes": 1000**k if k < 4 else 0}
    return tuple((base | given).values())


@pytest.fixture
def modules(spark):
    return lambda rows: spark.createDataFrame(rows, MODULE)


def pairs(df):
    return {(r["t_id"], r["r_id"]): round(r["confidence"], 6) for r in df.collect()}


def test_seeds_by_hand(modules):
    t = modules([module(0, strings=["a", "b", "x"]), module(1, strings=["a", "b", "c"]), module(2, strings=["q", "r"]), module(3, strings=["one"]), module(4, strings=["k", *"12345678"])])
    r = modules([module(0, "r", strings=["a", "b", "c"]), module(1, "r", strings=["q", "s", "t"]), module(2, "r", strings=["q", "u", "v"]), module(3, "r", strings=["k", "9", "10", *"abcdefghij"])])
    # t0 meets r0 at 0.5 and is evicted by t1; t2 has two equal best references; t3 has one string; t4 is under 0.15
    assert pairs(similarity.string_seeds(t, r)) == {("t1", "r0"): 1.0}
    assert similarity.seed_acceptances(t, r).first().asDict() == {"accepted": 2, "kept": 1}


def test_low_runner_up_still_blocks(modules):
    t = modules([module(0, strings=["a", "b", "c", "d", "e", "f"])])
    r = modules([module(0, "r", strings=["a", *"123"]), module(1, "r", strings=["b", *"45678"])])
    assert pairs(similarity.string_seeds(t, r)) == {}  # no score reaches 0.15
    r = modules([module(0, "r", strings=["a", "b", *"12345"]), module(1, "r", strings=["b", "c", *"678"]), module(2, "r", strings=["zz", "yy"])])
    assert pairs(similarity.string_seeds(t, r)) == {}  # 2/11 and 2/9


def ring(p, shift=0):
    """A chain of four modules; the first and third share strings with their counterparts."""
    own = {0: ["alpha", "beta"], 2: ["gamma", "delta"]}
    return [module(k, p, strings=own.get(k, []), deps_out=[f"{p}{k + 1}"] if k < 3 else [], deps_in=[f"{p}{k - 1}"] if k else [], ast_fingerprint="A:B", stmtCount=50 + k + shift, wrapKind="ESM" if shift else "CJS", bytes=0) for k in range(4)]


def test_neighbours_need_two_votes(modules):
    got = match.cascade(modules(ring("t")), modules(ring("r", 9)))
    assert pairs(got) == {("t0", "r0"): 1.0, ("t2", "r2"): 1.0, ("t1", "r1"): 0.95}  # t3 has one vote only
    assert {r["t_id"]: r["technique"] for r in got.collect()}["t1"] == "graph_propagation"


def test_structure_needs_no_common_string(modules):
    known = ["the same", "two strings"]
    lone = lambda p, words: module(1, p, strings=words, deps_in=[f"{p}0"], stmtCount=7, bytes=100)
    t = modules([module(0, strings=known, deps_out=["t1"]), lone("t", ["aaaaaa", "bbbbbb", "cccccc"])])
    r = modules([module(0, "r", strings=known, deps_out=["r1"]), lone("r", ["dddddd", "eeeeee", "ffffff"])])
    got = {x["t_id"]: (x["r_id"], x["technique"], round(x["confidence"], 6)) for x in match.cascade(t, r).collect()}
    assert got["t1"] == ("r1", "identifier_fingerprint", 0.43)  # boosts of 0.13 alone
    same = match.match_in_order([x.asDict() for x in t.collect()], [x.asDict() for x in r.collect()])
    assert {(a, b): round(c, 6) for a, b, c, _ in same} == {("t0", "r0"): 1.0, ("t1", "r1"): 0.43}


def brute_structure(t, r):
    f = lambda m: {s[:30] for s in m["strings"] if len(s) >= 6}
    best = {}
    for a in t:
        if len(f(a)) < 3:
            continue
        scores = []
        for b in r:
            if len(f(b)) < 3:
                continue
            x, y = a["bytes"], b["bytes"]
            s = len(f(a) & f(b)) / len(f(a) | f(b)) + (0.05 * (a["stmtCount"] == b["stmtCount"]) + 0.03 * (a["wrapKind"] == b["wrapKind"]) + 0.05 * (x > 0 and y > 0 and abs(x - y) / max(x, y) < 0.3))
            scores.append((-s, b["ord"], b["id"]))
        scores.sort()
        if scores and -scores[0][0] >= 0.1 and (len(scores) == 1 or scores[1][0] == 0 or -scores[0][0] >= -scores[1][0] * 1.3):
            best[a["id"]] = (scores[0][2], round(-scores[0][0], 6))
    return best


@pytest.mark.parametrize("seed", range(3))
def test_structure_equals_brute_force(modules, seed):
    rng = random.Random(seed)
    words = [f"string{k}" for k in range(40)]
    make = lambda p, n: [module(k, p, strings=rng.sample(words, rng.randint(2, 6)), stmtCount=rng.randint(1, 5), wrapKind=rng.choice(["CJS", "ESM", "None"]), bytes=rng.choice([0, 10, 12, 100, 5000])) for k in range(n)]
    t, r = modules(make("t", 40)), modules(make("r", 25))
    got = similarity.gate(similarity.top_two(similarity.structure_scores(t, r)), 0.10, 1.3).collect()
    want = brute_structure(*([x.asDict() for x in df.collect()] for df in (t, r)))
    assert {x["t_id"]: (x["r_id"], round(x["score"], 6)) for x in got} == want


@pytest.mark.parametrize("seed", range(2))
def test_hot_prefixes_equal_brute_force(modules, seed):
    rng = random.Random(seed)
    words = [f"string{k}" for k in range(300)]
    often = [300 / (k + 1) for k in range(300)]  # a few prefixes are in over 64 modules of each side
    size = lambda: rng.choice([0, 1, 2, 3, rng.randint(1, 40), rng.randint(1, 3000), 2 ** rng.randint(0, 12)])
    make = lambda p: [module(k, p, strings=rng.choices(words, often, k=rng.randint(3, 8)), stmtCount=rng.randint(1, 30), wrapKind=rng.choice(["CJS", "ESM", "None", "X"]), bytes=size()) for k in range(220)]
    t, r = modules(make("t")), modules(make("r"))
    got = similarity.gate(similarity.top_two(similarity.structure_scores(t, r)), 0.10, 1.3).collect()
    want = brute_structure(*([x.asDict() for x in df.collect()] for df in (t, r)))
    assert len(want) > 20 and {x["t_id"]: (x["r_id"], round(x["score"], 6)) for x in got} == want


def test_sizes_and_prefixes_of_many_modules_are_not_paired_in_full(modules):
    make = lambda p: modules([module(k, p, strings=["common", f"{p} {k} first", f"{p} {k} second"], stmtCount=k, wrapKind="X", bytes=5000 + k) for k in range(400)])
    assert rows_made(similarity.structure_scores(make("t"), make("r"))) < 60_000  # 400 x 400 pairs share a prefix, and are near in size


@pytest.mark.parametrize("seed", range(3))
def test_seeds_agree_with_matching_in_order(modules, seed):
    rng = random.Random(seed)
    make = lambda p: modules([module(k, p, strings=[str(rng.randrange(30)) for _ in range(rng.randint(1, 6))], bytes=0) for k in range(30)])
    t, r = make("t"), make("r")
    one = match.match_in_order([x.asDict() for x in t.collect()], [x.asDict() for x in r.collect()])
    assert pairs(similarity.string_seeds(t, r)) == {(a, b): round(c, 6) for a, b, c, how in one if how == "string_seed"}


def rows_made(df):
    """The most rows that an operator of ``df``'s plan has made."""
    df.collect()

    def walk(plan):
        name = plan.getClass().getSimpleName()
        below = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else [plan.children().apply(k) for k in range(plan.children().size())]
        own = plan.metrics().get("numOutputRows")
        return max([own.get().value() if own.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_a_string_of_many_sets_is_not_paired_in_full(modules):
    make = lambda p: modules([module(k, p, strings=["common", f"{p}{k}", f"own{k // 3}", *map(str, range(k % 4))], bytes=0) for k in range(300)])
    assert rows_made(similarity.string_seeds(make("t"), make("r"))) < 20_000  # 300 x 300 pairs share a string


@pytest.mark.parametrize("seed", range(2))
def test_hot_strings_agree_with_matching_in_order(modules, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    often = [300 / (k + 1) for k in range(400)]  # a few strings are in over 64 sets of each side
    make = lambda p: modules([module(k, p, strings=rng.choices(words, often, k=rng.randint(1, 7)), bytes=0) for k in range(400)])
    t, r = make("t"), make("r")
    one = match.match_in_order([x.asDict() for x in t.collect()], [x.asDict() for x in r.collect()])
    want = {(a, b): round(c, 6) for a, b, c, how in one if how == "string_seed"}
    assert len(want) > 20 and pairs(similarity.string_seeds(t, r)) == want


def test_targets_of_one_shape_share_their_candidates(modules):
    prints = lambda k: ":".join(["A", "B", "C", "D", f"r{k % 50}", *["A"] * (k // 50)])
    t = modules([module(k, ast_fingerprint="A:B:C:D:E", bytes=0) for k in range(200)])
    r = modules([module(k, "r", ast_fingerprint=prints(k), bytes=0) for k in range(100)])
    seeds = modules([module(0)]).select(F.lit("seed").alias("t_id"), F.lit("none").alias("r_id"))
    te = t.select("id", F.lit("seed").alias("near"), F.lit(True).alias("out"))
    assert rows_made(match.fingerprint_round(t, r, te, seeds)) < 10_000  # 200 targets are like 100 shapes
    only = [module(0, "r", ast_fingerprint="A:B:C:D:E", bytes=0)]
    got = match.fingerprint_round(t, modules(only), te, seeds).collect()
    assert [(x["t_id"], x["r_id"], x["confidence"]) for x in got] == [("t0", "r0", 0.8)]


def test_sequential_matching_takes_one_sided_pairs(modules):
    t = modules([module(0, strings=["a", "b"])]).withColumn("pair", F.lit("x"))
    r = modules([module(0, "r", strings=["a", "b"])]).withColumn("pair", F.lit("y"))
    assert match.cascade_exact(t, r).count() == 0
    both = match.cascade_exact(t, r.withColumn("pair", F.lit("x")))
    assert pairs(both) == {("t0", "r0"): 1.0}


def test_chain_of_two_bundles(modules):
    rows = []
    for b in "xy":
        for v in range(3):
            rows += [module(k, f"{b}", strings=[f"{b}{k}s1", f"{b}{k}s2"], semantic_name=f"name{k}" if v == 0 and k == 0 else None, deps_out=[f"{b}1"] if k == 0 else [], deps_in=[f"{b}0"] if k == 1 else [], bytes=v) for k in range(2)]
    df = modules(rows).withColumn("bkg_id", F.concat(F.lit("v"), "bytes")).withColumn("bundle", F.substring("id", 1, 1))
    out, report = chain.chain(df, ["v0", "v1", "v2"], "bundle")
    assert sorted(tuple(r) for r in report.collect()) == [("v0", "v1", 4, 4, 1.0), ("v1", "v2", 4, 4, 1.0)]
    got = {(r["bkg_id"], r["id"]): r["semantic_name"] for r in out.collect()}
    assert got["v1", "x0"] == got["v2", "y0"] == "name0" and got["v2", "x1"] == "m1" and len(got) == 12
    assert "pair" not in out.columns
    with pytest.raises(ValueError):
        chain.chain(df, ["v0"])


def test_transfer(modules):
    t, r = modules([module(0), module(1)]), modules([module(0, "r", semantic_name="", source_file="f.ts"), module(1, "r", semantic_name="good")])
    found = t.sparkSession.createDataFrame([("t0", "r0", 0.5, "string_seed"), ("t1", "r1", 0.6, "ast_fingerprint")], "t_id string, r_id string, confidence double, technique string")
    got = {x["id"]: (x["semantic_name"], x["semantic_source"], x["source_file"]) for x in match.transfer(t, r, found).collect()}
    assert got == {"t0": ("m0", "cross_version_match:string_seed", "f.ts"), "t1": ("good", "cross_version_match:ast_fingerprint", None)}


def chain_of(n):
    ids = [f"n{k}" for k in range(n)]
    out = {i: [ids[k + 1]] if k + 1 < n else [] for k, i in enumerate(ids)}
    into = {i: [ids[k - 1]] if k else [] for k, i in enumerate(ids)}
    return ids, out, into


def test_propagation_in_order():
    ids, out, into = chain_of(15)
    given = graph.propagate_in_order(ids, {"n0": "root"}, dict.fromkeys(ids, 1), out, into)
    assert len(given) == 14 and given["n14"] == ("near_root", 0.6)  # one pass, since names count at once; one prefix only
    back = graph.propagate_in_order(ids, {"n14": "root"}, dict.fromkeys(ids, 1), out, into)
    assert sorted(back) == sorted(f"n{k}" for k in range(4, 14))  # against the order: a step a pass, ten passes
    ring = ({"a": ["b"], "b": ["a"]}, {"a": ["b"], "b": ["a"]})
    assert graph.propagate_in_order(["a", "b"], {}, {}, *ring) == {}
    assert graph.propagate_in_order(["a"], {}, {"a": 1}, {"a": ["gone"]}, {}) == {}
    star = {"c": ["x1", "x2", "x3", "x4", "x5"]}
    assert graph.propagate_in_order(["c"], {"x1": "A", "x2": "B"}, {}, star, {"x2": ["c", "d"], "x1": ["c"]})["c"][0] == "near_B"  # 2 of 5 is enough; the larger fan-in
    assert graph.propagate_in_order(["c"], {"x1": "A"}, {}, star, {}) == {}


def test_rounds_reach_what_passes_reach(spark):
    ids, out, into = chain_of(6)
    rows = spark.createDataFrame([("g", i, k, "root" if k == 0 else None, None, None, ["s"]) for k, i in enumerate(ids)], "bkg_id string, id string, ord long, semantic_name string, semantic_confidence double, semantic_source string, strings array<string>")
    edges = spark.createDataFrame([("g", a, b) for a, bs in out.items() for b in bs], "bkg_id string, src string, dst string")
    named = {r["id"]: r["semantic_name"] for r in graph.propagate_rounds(rows, edges).collect()}
    assert named == {"n0": "root"} | {f"n{k}": "near_root" for k in range(1, 6)}
    assert {r["id"]: r["depth"] for r in graph.closure(edges, spark.createDataFrame([("g", "n2")], "bkg_id string, start string")).collect()} == {"n2": 0, "n3": 1, "n4": 2, "n5": 3}
    assert {r["id"]: (r["fan_out"], r["fan_in"]) for r in graph.degrees(edges).collect()}["n1"] == (1, 1)


@pytest.mark.parametrize(("n", "noise"), [(2, 2), (3, 3), (6, 5)])
def test_recurrence_threshold(modules, n, noise):
    rows = [module(k, f"p{p}_", strings=[f"in{k}"], bytes=10) for p in range(n) for k in range(n) if p < n - k]
    rows += [module(99, "p0_", strings=["in0"], bytes=10)]  # twice in one input counts once
    df = modules(rows).withColumn("pair", F.split("id", "_")[0])
    left = {r["id"] for r in ops.evolve(df).collect()}
    spread = lambda k: n - k
    assert left == {f"p{p}_{k}" for p in range(n) for k in range(n) if p < n - k and spread(k) < noise}
    assert {r["pair"]: r["real_new"] for r in ops.evolve_report(df, ops.evolve(df)).collect()}.keys() == {f"p{p}" for p in range(n)}


def test_merge_rules(modules):
    a = modules([module(0, "", semantic_name="one", semantic_confidence=0.5, strings=[str(k) for k in range(40)]), module(1, "", semantic_name="same", semantic_confidence=0.1), module(2, "", semantic_name="kept"), module(3, "")])
    b = modules([module(0, "", semantic_name="two", semantic_confidence=0.5, strings=[str(k) for k in range(30, 80)]), module(1, "", semantic_name="same", semantic_confidence=0.9), module(2, "", semantic_name="lost"), module(4, "")])
    got = {r["id"]: r for r in ops.merge_modules(a, b).collect()}
    assert {i: (r["semantic_name"], r["conflict"]) for i, r in got.items()} == {"0": ("one", False), "1": ("same", False), "2": ("kept", False), "3": (None, False), "4": (None, False)}
    assert len(got["0"]["strings"]) == 50 and got["1"]["semantic_confidence"] == 0.9
    assert {r["status"]: r["count"] for r in ops.diff(a, b).groupBy("status").count().collect()} == {"shared": 3, "removed": 1, "added": 1}


@pytest.mark.parametrize("seed", [0, 1])
def test_alike_shapes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    some = [sorted(set(rng.choices("ABCDEFGHIJKL", range(1, 13), k=rng.randint(1, 8)))) for _ in range(120)]
    shapes = sorted({(tuple(k), len(k) + rng.randint(0, 9)) for k in some})
    frame = lambda rows, p: spark.createDataFrame([(list(k), n) for k, n in rows], f"{p}_kinds array<string>, {p}_len int")
    got = {(tuple(x["t_kinds"]), x["t_len"], tuple(x["r_kinds"]), x["r_len"]): x["score"] for x in match.alike_shapes(frame(shapes[::2], "t"), frame(shapes[1::2], "r")).collect()}
    score = lambda a, m, b, n: len(set(a) & set(b)) / max(len(a), len(b)) * (min(m, n) / max(m, n))
    want = {(a, m, b, n): s for a, m in shapes[::2] for b, n in shapes[1::2] if (s := score(a, m, b, n)) >= 0.58}
    assert got == want and len(want) > 50


def brute_cascade(t, r):
    """Plain rounds: everything found in a round sees only what was found before it; the first target wins."""
    refs = {x["id"]: x for x in r}
    found = {a: (b, how, c) for a, b, c, how in match.match_in_order(t, r) if how == "string_seed"}

    def claimed(rows):
        taken = set()
        for i, ref, how, c in rows:
            if ref not in taken:
                taken.add(ref)
                found[i] = (ref, how, c)

    def free():
        return [x for x in r if x["id"] not in {b for b, _, _ in found.values()}]

    def open_targets():
        return [m for m in t if m["id"] not in found and any(d in found for d in m["deps_out"] + m["deps_in"])]

    def similar(a, b):
        x, y = (a or "").split(":"), (b or "").split(":")
        return len(set(x) & set(y)) / max(len(set(x)), len(set(y))) * min(len(x), len(y)) / max(len(x), len(y)) if a and b else 0.0

    def leader(scores, least, ratio):
        order = sorted(scores, key=lambda s: -s[0])
        if order and order[0][0] >= least and (len(order) == 1 or order[1][0] == 0 or order[0][0] >= order[1][0] * ratio):
            return order[0]
        return None

    while True:
        rows, left = [], {x["id"] for x in free()}
        for m in open_targets():
            sides = [refs[found[d][0]]["deps_in"] for d in m["deps_out"] if d in found] + [refs[found[d][0]]["deps_out"] for d in m["deps_in"] if d in found]
            votes = Counter(x for s in sides for x in s if x in left).most_common()
            if votes and votes[0][1] >= 2 and (len(votes) == 1 or votes[0][1] > votes[1][1]):
                c = min(0.95, 0.5 + votes[0][1] / len(sides) * 0.3 + similar(m["ast_fingerprint"], refs[votes[0][0]]["ast_fingerprint"]) * 0.3)
                rows.append((m["id"], votes[0][0], "graph_propagation", c))
        if not rows:
            break
        claimed(rows)
    left = free()
    best = [(m, leader([(similar(m["ast_fingerprint"], x["ast_fingerprint"]), x["id"]) for x in left], 0.7, 1.2)) for m in open_targets() if len((m["ast_fingerprint"] or "").split(":")) >= 5]
    claimed([(m["id"], b[1], "ast_fingerprint", b[0] * 0.8) for m, b in best if b])
    left, marks = free(), lambda m: {s[:30] for s in m["strings"] if len(s) >= 6}
    rows = []
    for m in open_targets():
        scores = []
        for x in left:
            f, g = marks(m), marks(x)
            if len(f) >= 3 and len(g) >= 3:
                near = abs(m["bytes"] - x["bytes"]) / max(m["bytes"], x["bytes"]) < 0.3
                scores.append((len(f & g) / len(f | g) + 0.05 * (m["stmtCount"] == x["stmtCount"]) + 0.03 * (m["wrapKind"] == x["wrapKind"]) + 0.05 * near, x["id"]))
        if b := leader(scores, 0.10, 1.3):
            rows.append((m["id"], b[1], "identifier_fingerprint", min(0.85, b[0] + 0.3)))
    claimed(rows)
    return {(i, ref, how, round(c, 9)) for i, (ref, how, c) in found.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_cascade_equals_plain_rounds(modules, seed):
    rng, n = random.Random(seed), 70
    deps = [rng.sample(range(n), rng.choice([0, 1, 1, 2])) for _ in range(n)]
    shape = [":".join(rng.choices("ABCDEFGH", k=rng.randint(3, 9))) for _ in range(n)]
    words = [[f"string{k}_{j}" for j in range(rng.choice([0, 0, 3, 4]))] for k in range(n)]

    def side(p):
        rows = []
        for k in range(n):
            told = words[k] if rng.random() < 0.5 else [f"{p}{w}" if rng.random() < 0.85 else w for w in words[k]]
            rows.append(module(k, p, strings=told, ast_fingerprint=shape[k] if rng.random() < 0.7 else None, deps_out=[f"{p}{d}" for d in deps[k]], deps_in=[f"{p}{j}" for j in range(n) if k in deps[j]], stmtCount=k % 9, wrapKind="CJS" if k % 3 else "ESM", bytes=100 + 37 * k))
        return modules(rows)

    t, r = side("t"), side("r")
    rows = lambda df: [x.asDict() for x in df.orderBy("ord").collect()]
    got = {(x["t_id"], x["r_id"], x["technique"], round(x["confidence"], 9)) for x in match.cascade(t, r).collect()}
    assert got == brute_cascade(rows(t), rows(r))
    assert len({how for _, _, how, _ in got}) == 4

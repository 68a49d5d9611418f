import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import exact_dedup, mixing, simhash, token_planes

ODD = [None, "", " \n", "a b", "ab", " a\tb ", "a b", "é", "long " * 30_000, "Long", None]


def test_exact_dedup(docs):
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(ODD)).collect()}
    strip = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for k, t in enumerate(ODD):
        groups[strip(t)].append((-len(t or ""), k))
    for members in groups.values():
        keep = min(members)[1]
        for _, k in members:
            assert (got[k]["keep_id"], got[k]["group_size"], got[k]["kept"]) == (keep, len(members), k == keep)
    assert exact_dedup.exact_dedup(docs([])).count() == 0


@pytest.mark.parametrize("heavy_k", [2, 512])
def test_exact_dedup_hot_and_repeated_rows(docs, heavy_k):
    texts = ["hot  text"] * 40 + ["hot text"] * 40 + [f"t{k}" for k in range(20)] + ["same", "same"]
    out = exact_dedup.exact_dedup(docs(texts, ids=[*range(100), 7000, 7000]), heavy_k=heavy_k).collect()
    assert len(out) == 102
    assert sum(r["kept"] for r in out) == 22
    assert [r["keep_id"] for r in out if r["group_size"] == 80] == [0] * 80


def test_water_fill():
    assert mixing.water_fill([100, 100, 100], [3, 1, 2], 1.5, 2) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.water_fill([], [], 1.5, 2) == []
    assert mixing.water_fill([0, 10], [3, 1], 1.5, 2) == pytest.approx([0, 15])


def test_flow_serves_overlapping_sources():
    flow = mixing.min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 5}, {"a": 15, "b": 15}, 2)
    given = defaultdict(int)
    for f in flow.values():
        for s, n in f.items():
            given[s] += n
    assert given == {"a": 15, "b": 15}
    # repeats (cost 1) only as far as first passes (25 words) do not cover the quotas (30)
    assert sum(max(0, sum(f.values()) - {("a",): 10, ("a", "b"): 10, ("b",): 5}[p]) for p, f in flow.items()) == 5


def least_cost(capacity, quota, repeats):
    """Most words and least cost of a flow in whole words, by trying all of them (two sources)."""
    best = (0, 0)
    patterns = list(capacity)

    def go(k, left, flow, cost):
        nonlocal best
        if k == len(patterns):
            best = min(best, (-flow, cost))
            return
        p, c = patterns[k], capacity[patterns[k]]
        for x in range(min(left.get(p[0], 0), c * repeats) + 1):
            for y in range(min(left.get(p[-1], 0), c * repeats - x) + 1) if len(p) > 1 else (0,):
                n = x + y
                new = dict(left)
                new[p[0]] -= x
                if len(p) > 1:
                    new[p[1]] -= y
                go(k + 1, new, flow + n, cost + sum(r * min(c, max(0, n - r * c)) for r in range(repeats)))

    go(0, dict(quota), 0, 0)
    return best


def test_flow_has_least_cost():
    rng = random.Random(5)
    for _ in range(25):
        capacity = {p: rng.randint(1, 3) for p in [("a",), ("a", "b"), ("b",)] if rng.random() < 0.8} or {("a",): 2}
        quota = {s: rng.randint(0, 5) for s in {s for p in capacity for s in p}}
        got = mixing.routed(capacity, quota, 2)
        cost = sum(r * min(capacity[p], max(0, n - r * capacity[p])) for p, n in got.items() for r in range(2))
        assert (-sum(got.values()), cost) == least_cost(capacity, quota, 2)


def test_mix_of_many_sources_and_null_ids(docs):
    from pyspark.sql import functions as F

    many = docs(["w w w w"] * 5000, sources=[f"s{k % 2500}" for k in range(5000)])
    got = mixing.mix(many, F.array("source"), mixing.by_turns).collect()
    assert len(got) == 5000 and abs(sum(r["taken"] for r in got) - 30_000) <= 4 * 2500
    nulls = docs([f"w{k} " * 20 for k in range(300)], ids=[None] * 300, sources=["ab"[k % 2] for k in range(300)])
    taken, target = defaultdict(int), {}
    for r in mixing.mix(nulls, F.array("source"), mixing.by_turns).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 40 for s, t in target.items())


def test_mix_comes_near_targets(docs, spark):
    rng = random.Random(1)
    texts = ["w " * rng.randint(0, 40) for _ in range(600)] + [None, ""]
    sources = [rng.choice(["a", "b", "c", None]) for _ in texts]
    from pyspark.sql import functions as F

    run = lambda: mixing.mix(docs(texts, sources=sources), F.array("source"), mixing.by_turns).collect()
    got = run()
    assert len(got) == len(texts)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len((texts[r["doc_id"]] or "").split())
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = mixing.water_fill([size[s] for s in ("a", "b", "c", None)], [3, 1, 2, 3], 1.5, 2)
    for s, t in zip(("a", "b", "c", None), want, strict=True):
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= 40
    assert sorted((r["doc_id"], r["taken"]) for r in run()) == sorted((r["doc_id"], r["taken"]) for r in got)
    assert mixing.mix(docs([]), F.array("source"), mixing.by_turns).count() == 0
    clash = docs(texts, sources=sources).withColumns({"size": F.lit("x"), "target": F.lit("y"), "pattern": F.lit(1)})
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mix(clash, F.array("source"), mixing.by_turns).collect()) == sorted((r["doc_id"], r["taken"]) for r in got)
    row = mixing.planned(clash, F.array("source"), mixing.by_turns).select("row.*").first()
    assert (row["size"], row["target"], row["pattern"]) == ("x", "y", 1)


def brute_simhash(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    sh = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_fingerprints_and_components(docs):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd") for _ in range(3)) for _ in range(200)]
    texts = list(ODD)
    for _ in range(60):
        ws = list(base)
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(len(ws))] = "zz" + str(rng.random())
        texts.append(" ".join(ws))
    fps = [brute_simhash(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs(texts)).collect()}
    assert got == {k: (fps[k], find(k)) for k in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_links_lose_no_component(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(6):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    fps = sorted(f - 2**64 if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for blocks in (8, 12):
        near = simhash.candidates(df, blocks)
        assert {x for r in near.collect() for x in r} >= {a for a in fps for b in fps if a != b and ((a ^ b) % 2**64).bit_count() <= 3}
    got = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(near)).collect()}
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) % 2**64).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**60), 2**60)), st.lists(st.integers(0, 2**32 - 1), max_size=30)), max_size=8), st.sampled_from([1, 4, 7, 64]), st.booleans())
def test_segment_round_trip(docs, block, bits):
    ids = np.array([x for _, d in docs for x in d], "<u4")
    index = [(i, len(d)) for i, d in docs]
    got, back = token_planes.decode_segment(token_planes.encode_segment(index, ids, block, bits))
    assert got == index and back.tolist() == ids.tolist()


TEXTS = [None, "", "It's thea, thea. A.b! x1.2?! don't", "ÉÈ été…. naïve. 日本語. á. ,., '' 's", "<|endoftext|> x.<|STARTOFTEXT|>", "w." * 5000, "   x . İı ß", "a'S. 'RE, x's. 1.,2"]


def test_word_cache_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, cache = Tokenizer.from_file(path), token_planes.WordCache(path, room=5)
    for t in TEXTS * 2:
        assert np.frombuffer(cache(t or ""), "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_planes_hold_all_documents(docs, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    ids = [5, 3, -2, 900, 40, 41, 42, 43]
    got = sorted(tuple(r) for r in token_planes.read_documents(token_planes.write_segments(docs(TEXTS, ids=ids), path, block=16, bits=True)).collect())
    want, start = [], 0
    for i, t in sorted(zip(ids, TEXTS, strict=True), key=lambda x: x[0]):
        e = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(e), zlib.crc32(e.tobytes())))
        start += len(e)
    assert got == want
    assert token_planes.read_documents(token_planes.write_segments(docs([]), path)).count() == 0

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import importance, langid, line_dedup, template_decontam, url_graph

VOCAB = {"en": "the of and to in that was with reading".split(), "de": "der die und zu nicht über größe schon".split(), "fr": "le la et être où forêt dans leçon".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(VOCAB[lang]) + rng.choice(["", "", ".", ","]) for _ in range(n))


def test_language(docs):
    rng = random.Random(1)
    langs = [rng.choice(list(VOCAB)) for _ in range(400)]
    texts = [prose(rng, c, rng.randint(5, 60)) for c in langs] + [None, "", "12 !? 7", "x", "der " * 50_000]
    langs += [None, "en", "en", None, "de"]
    out = langid.identify(docs(texts, langs=langs)).collect()
    assert len(out) == len(texts)
    got = {r["doc_id"]: r for r in out}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert [got[k]["lang_pred"] for k in (400, 401, 402)] == ["und"] * 3
    held = [k for k in range(400) if got[k]["held_out"]]
    assert np.mean([got[k]["lang_pred"] == langs[k] for k in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out) and got[404]["lang_pred"] == "de"
    # labels of held-out rows do not matter
    other = ["en" if got[k]["held_out"] else c for k, c in enumerate(langs)]
    again = {r["doc_id"]: r for r in langid.identify(docs(texts, langs=other)).collect()}
    assert all(again[k]["lang_pred"] == got[k]["lang_pred"] and again[k]["score"] == got[k]["score"] for k in got)
    assert langid.identify(docs([])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs(["abc"], langs=[None])).collect()} == {"und"}


def test_quality_prefers_target_like_text(docs, spark):
    rng = random.Random(2)
    good = [rng.random() < 0.7 for _ in range(500)]
    texts = [prose(rng, "en" if g else "fr", rng.randint(20, 60)) for g in good]
    labels = spark.createDataFrame([(k, int(g), 0) for k, g in enumerate(good) if k % 2], "doc_id long, quality int, toxic int")
    out = importance.select_quality(docs(texts), labels).collect()
    share = sum(g for k, g in enumerate(good) if k % 2) / 250
    assert sum(r["kept"] for r in out) == round(500 * share)
    assert np.mean([r["kept"] == good[r["doc_id"]] for r in out]) > 0.93
    odd = importance.select_quality(docs([None, "", "a b", "a b"]), labels.limit(0)).collect()
    assert [r["kept"] for r in odd] == [True] * 4
    assert importance.select_quality(docs([]), labels).count() == 0


def test_quality_keeps_exactly_k_of_repeated_rows_and_null_ids(docs, spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    for ids, k in (([5] * 8, 2), ([None] * 12, 3), ([9, None, None, 9, None, None, 9, None], 2), ([None] * 5 + [3] * 3, 2)):
        out = importance.select_quality(docs(["one equal text"] * len(ids), ids=ids).repartition(3), labels).collect()
        assert len(out) == len(ids) and sum(r["kept"] for r in out) == k


def test_first_tied(spark):
    rng = random.Random(3)
    tied = [(rng.choice([None, 1, 2, 3, 9]), rng.randrange(4) << 33 | k) for k in range(60)]
    df = spark.createDataFrame(tied, "doc_id long, row long")
    order = sorted(tied, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for n in (1, 7, 30, 59, 60):
        for step in (1, 2, 1000):
            got = {tuple(r) for r in df.where(importance.first_tied(df, n, step)).collect()}
            assert got == set(order[:n])


def test_quality_weights_equal_plain_models(docs, spark):
    rng = random.Random(21)
    texts = [prose(rng, rng.choice(list(VOCAB)), rng.randint(0, 40)) for _ in range(80)] + [None, "", "word " * 30_000]
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 9 == 0)) for k in range(0, 80, 2)], "doc_id long, quality int, toxic int")
    grams = [importance.grams(t) for t in texts]
    n = np.ones((2, importance.BUCKETS))
    for k, g in enumerate(grams):
        for b in g.tolist():
            n[0, b] += 1
            n[1, b] += k < 80 and k % 2 == 0 and k % 3 == 0 and k % 9 != 0
    p = n / n.sum(1, keepdims=True)
    out = {r["doc_id"]: r for r in importance.select_quality(docs(texts), labels).collect()}
    for k, g in enumerate(grams):
        assert out[k]["log_weight"] == pytest.approx(sum(np.log(p[1, b]) - np.log(p[0, b]) for b in g.tolist()), abs=1e-6)
    k = round(len(texts) * 14 / 40)
    best = sorted(out.values(), key=lambda r: -r["gumbel_key"])[:k]
    assert {r["doc_id"] for r in out.values() if r["kept"]} == {r["doc_id"] for r in best}


@pytest.mark.parametrize("n,k", [(50, 7), (9000, 4321), (9000, 1), (9000, 8999)])
def test_kth_largest(spark, n, k):
    rng = random.Random(n + k)
    values = [rng.choice([rng.random(), 0.5, 7.0 * rng.random() ** 9]) for _ in range(n)]
    cut, ties = importance.kth_largest(spark.createDataFrame([(v,) for v in values], "key double"), k, few=100)
    assert cut == sorted(values, reverse=True)[k - 1]
    assert ties == k - sum(v > cut for v in values)


URLS = ["http://A.b.org/x?q#f", "https://example.org/es/1", "http://www.example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/9", "http://x.com/en", "http://x.com", "nothing", None, "http://", "http://forg/", "http://x.net/a#b?c", "http://y.net?z/w", "a\nb://HOST/pa th"]


def test_url_rules_and_parts(spark):
    pages = spark.createDataFrame([(k, u, None, "z") for k, u in enumerate(URLS)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_graph.judge(pages).collect()}
    want = [("a.b.org", "/x", "org/", "allow"), ("example.org", "/es/1", "example.org/es/", "block"), ("www.example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/9", "com/de/", "block"), ("x.com", "/en", None, None), ("x.com", "", None, None), ("", "", None, None), ("", "", None, None), ("", "", None, None), ("forg", "/", None, None), ("x.net", "/a", None, None), ("y.net", "", None, None), ("host", "/pa th", None, None)]
    for k, (host, path, rule, verdict) in enumerate(want):
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_graph.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize("heavy_k", [2, 512])
def test_propagation_equals_power_iteration(spark, heavy_k):
    rng = random.Random(4)
    hosts = [f"h{k}.net" for k in range(12)] + ["good.org", "x.com"]
    rows = []
    for k in range(120):
        src = rng.choice(hosts)
        path = rng.choice(["/de/1", "/en/1"]) if src == "x.com" else "/a"
        html = " ".join(f'<a HREF="{rng.choice(["http:", "HTTPS:", ""])}//{rng.choice(hosts).upper()}/q">' for _ in range(rng.randint(0, 3))) + '<a href="/local">'
        rows.append((k, f"http://{src}{path}", html))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = url_graph.judge(pages, heavy_k=heavy_k, tolerance=0.01).collect()
    assert len(out) == 120
    import re

    links, seeds = defaultdict(int), {"trust": defaultdict(float), "distrust": defaultdict(float)}
    for r in out:
        if r["rule"]:
            seeds["trust" if r["verdict"] == "allow" else "distrust"][r["host"]] += 1
    for _, url, html in rows:
        src = url.split("/")[2]
        for dst in re.findall(r"//([^/\"]+)/q", html):
            if dst.lower() != src:
                links[src, dst.lower()] += 1
    score = {}
    for kind, back in (("trust", False), ("distrust", True)):
        edges = {((b, a) if back else (a, b)): n for (a, b), n in links.items()}
        out_n = defaultdict(int)
        for (a, _), n in edges.items():
            out_n[a] += n
        total = sum(seeds[kind].values())
        seed = {h: n / total for h, n in seeds[kind].items()}
        r = {h: 0.15 * s for h, s in seed.items()}
        change = 1.0
        while change >= 0.01:
            new = defaultdict(float, {h: 0.15 * s for h, s in seed.items()})
            for (a, b), n in edges.items():
                new[b] += 0.85 * r.get(a, 0) * n / out_n[a]
            change = sum(abs(new.get(h, 0) - r.get(h, 0)) for h in {*new, *r})
            r = new
        score[kind] = r
    for r in out:
        assert r["host_trust"] == pytest.approx(score["trust"].get(r["host"], 0), abs=1e-9)
        assert r["host_distrust"] == pytest.approx(score["distrust"].get(r["host"], 0), abs=1e-9)
        if not r["rule"]:
            assert r["verdict"] == ("block" if r["host_distrust"] > r["host_trust"] else "allow")
    assert {r["verdict"] for r in out if not r["rule"]} == {"allow", "block"}


ITEM = "If a train travels 120 km from Boston in 3 hours, how far does the train from Boston go in 7 hours today?"


def test_decontamination(docs, spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (2, "The quick brown fox leaps over", "x"), (3, "too short one", "x"), (4, None, "x"), (5, "", "x")], "item_id long, text string, doc_id string")
    texts = [
        "Some words before. " + ITEM + " And after",
        ITEM.replace("120", "95").replace("Boston", "Lima").replace("km", "miles").replace(" 3 ", " 8 ").replace(" 7 ", " 6 "),
        ITEM.replace("from Boston in", "from Lima in", 1),  # one slot, two values
        ITEM.replace(" 7 ", " 3 "),  # two slots, one value
        "we saw the QUICK brown\tfox, leaps over it",
        "12 13 14 " * 40, None, "", "too short one", "  " + ITEM.lower().replace("boston", "Boston"), "entirely clean text of no interest to anybody at all here",
        "w " * 40_000 + ITEM,
    ]
    want = [(0, 1, "verbatim"), (1, 1, "reparameterised"), (4, 2, "verbatim"), (8, 3, "verbatim"), (9, 1, "verbatim"), (11, 1, "verbatim")]
    for limit in (200_000, 0):
        got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in template_decontam.leaks(docs(texts), items, broadcast_windows=limit).collect())
        assert got == want
    kept = template_decontam.decontaminate(docs(texts), items)
    assert kept.columns == docs([]).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 5, 6, 7, 10]
    assert template_decontam.leaks(docs([]), items).count() == 0
    assert template_decontam.leaks(docs(texts), items.limit(0)).count() == 0
    words = docs(["it's 3 km, 4.5kg Über Öl  !! x. New York a\tb"]).select(template_decontam.template_words(F.col("text")).alias("t"), template_decontam.plain_words(F.col("text")).alias("p")).first()
    assert len(words["t"]) == len(words["p"])


LONG = "When a ship leaves the port of Boston with 40 barrels of oil and every barrel weighs 90 kg how much does the cargo weigh at noon tomorrow"


def test_decontamination_finds_moved_words(docs, spark):
    items = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    texts = [
        LONG.replace("Boston", "New York"),
        LONG.replace("Boston", "Rio de Janeiro").replace("40", "55"),
        LONG.replace("and every", "and then every"),
        LONG.replace("and every", "every"),
        LONG.replace("Boston", "New York City").replace("and every", "and so every").replace("90 kg", "40 kg"),  # two slots, one value
        LONG.replace("and every", "and " + "very " * 9 + "every").replace("cargo", "x"),  # too far apart, too little left
    ]
    got = sorted((r["doc_id"], r["kind"]) for r in template_decontam.leaks(docs(texts), items).collect())
    assert got == [(0, "reparameterised"), (1, "reparameterised"), (2, "verbatim"), (3, "verbatim")]
    odd = ["in New York City, Old Town x", "Paris Texas is New  Delhi\tHills", "a New York's B, Über Öl", "the New\ue003York x", "New York New York", "e\u0301 New Yor\u0301k City", "by A New B York c"]
    words = docs(odd).select(template_decontam.template_words(F.col("text")).alias("t"), template_decontam.plain_words(F.col("text")).alias("p")).collect()
    assert [len(r["t"]) for r in words] == [len(r["p"]) for r in words]
    assert words[0]["p"] == ["in", "new\ue003york\ue003city", "old\ue003town", "x"]


def test_decontamination_finds_every_verbatim_item(docs, spark):
    texts = ["What is 12 plus 30?", "Add 3, 4, 5, 6 and 7, then subtract 2 and 1.", "The quick brown fox leaps over", "Who was Martin Luther King?", "1 2 3 4 5 6 7 8 9 10", "In Rome Anna met Karl at 5 pm and they ate 7 of 9 cakes before the long walk home began", "In Boston the ferry leaves at noon and the same ferry is back in Boston at night"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    around = [f"we said {t} And more" for t in texts] + [f"{t.lower()} x" for t in texts] + ["what is 13 plus 30 add 3 4 5 6 and 8"]
    for limit in (200_000, 0):
        got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in template_decontam.leaks(docs(around), items, broadcast_windows=limit).collect())
        assert got == [(k, k % 7, "verbatim") for k in range(14)]


def test_decontamination_finds_changed_questions(docs, spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    texts = [ITEM.lower(), ITEM.upper(), ITEM.replace("Boston", "New York"), ITEM.replace("how far does", "how long does"), ITEM.replace("does the train", "does really that the train"), "an other text of no interest to any of us", ITEM]
    got = {r["doc_id"]: r["kind"] for r in template_decontam.leaks(docs(texts), items).collect()}
    assert got == {0: "verbatim", 1: "verbatim", 2: "reparameterised", 3: "verbatim", 4: "verbatim", 6: "verbatim"}
    # null ids and equal ids with other texts are documents of their own
    for id_ in (None, 7):
        kept = template_decontam.decontaminate(docs([ITEM, "clean text", "clean text", "some other text"], ids=[id_] * 4), items).collect()
        assert sorted(r["text"] for r in kept) == ["clean text", "clean text", "some other text"]


def test_decontamination_of_long_runs(docs, spark):
    """Runs of names or of numbers in one text, and words, of any length."""
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    runs = [" Anna" * 20_000, " 1" + ".1" * 20_000, " A" + "b" * 20_000, " Anna Bea" * 10_000 + " 3" + ":4" * 10_000]
    texts = [f"we saw{r} here. {ITEM}" for r in runs] + [f"we saw{r} here" for r in runs]
    words = docs(texts).select("doc_id", template_decontam.template_words(F.col("text")).alias("t"), template_decontam.plain_words(F.col("text")).alias("p")).orderBy("doc_id").collect()
    assert [r["t"][2:-1] for r in words[4:]] == [["\ue000"], ["\ue001"], ["\ue000"], ["\ue000", "\ue001"]]
    assert [len(r["t"]) for r in words] == [len(r["p"]) for r in words]
    got = sorted((r["doc_id"], r["kind"]) for r in template_decontam.leaks(docs(texts), items).collect())
    assert got == [(k, "verbatim") for k in range(4)]


def brute_leaks(docs, items, window=5, fixed=2, share=0.5, least=4, shift=3):
    """Pairs found by the rule on lists of words: ``docs`` and ``items`` as (id, [(template words, plain words), ...], raw words)."""
    slot = lambda w: any(c in w for c in "\ue000\ue001\ue002")
    wins = lambda ws: [tuple(ws[i : i + window]) for i in range(max(1, len(ws) - window + 1))] if ws != [""] else []
    out = set()
    for i, forms, raw in items:
        tries = []
        for after, (tmpl, plain) in enumerate(forms):
            use = [k for k, w in enumerate(wins(tmpl)) if sum(not slot(x) for x in w) >= fixed]
            use = use if sum(not slot(x) for x in tmpl) >= window else []
            tries.append((False, tmpl, plain, use, share))
            if not after:
                tries.append((True, raw, raw, range(len(wins(raw))), share if len(use) < share * len(wins(tmpl)) else 1.0))
        for d, ((tmpl_d, plain_d), *_), raw_d in docs:
            for is_raw, ws, vs, use, need in tries:
                other, values = (raw_d, raw_d) if is_raw else (tmpl_d, plain_d)
                hits = [(q - k, k, q) for k in use for q, w in enumerate(wins(other)) if w == wins(ws)[k]]
                for low in {h[0] - m for h in hits for m in range(shift + 1)}:
                    for more in range(shift + 1):
                        part = [h for h in hits if low <= h[0] <= low + more]
                        n = len({k for _, k, _ in part})
                        if not n or n < need * len(use) or n < min(least, len(use)):
                            continue
                        pairs = {(ws[k + x], vs[k + x], values[q + x]) for _, k, q in part for x in range(min(window, len(ws))) if slot(ws[k + x])}
                        if len({(t, a) for t, a, _ in pairs}) == len({(t, b) for t, _, b in pairs}) == len(pairs):
                            out.add((d, i))
    return out


def test_decontamination_equals_brute_force(docs, spark):
    rng = random.Random(12)
    vocab = ["alpha", "beta", "gamma", "delta", "the", "of", "12", "7", "km", "Boston", "New York", "Lima", "3.5", "and,", "in"]
    make = lambda n: [rng.choice(vocab) for _ in range(n)]
    sources = [make(n) for n in (3, 5, 6, 8, 9, 12, 15, 20, 30, 14, 18)]
    texts = []
    for _ in range(120):
        ws = list(rng.choice(sources))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(ws))
            ws[k : k + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocab)], make(2)])
        if rng.random() < 0.2:
            a, b = rng.sample(["12", "7", "3.5", "Boston", "Lima", "99"], 2)
            ws = [b if w == a else w for w in ws]
        texts.append(" ".join(make(rng.choice([0, 0, 4])) + ws + make(rng.choice([0, 3]))))
    texts += ["", "..", None]
    item_texts = [" ".join(s) for s in sources]
    forms = lambda df: [(r["t"], r["p"], r["r"]) for r in df.orderBy("doc_id").select(template_decontam.template_words(F.col("text")).alias("t"), template_decontam.plain_words(F.col("text")).alias("p"), template_decontam.raw_words(F.col("text")).alias("r")).collect()]
    some = [(k, t) for k, t in enumerate(texts) if t is not None]
    doc_rows = [(k, [(t, p)], r) for (k, _), (t, p, r) in zip(some, forms(docs([t for _, t in some])), strict=True)]
    first, later = forms(docs(item_texts)), forms(docs(["x " + t for t in item_texts]))
    item_rows = [(k, [(t, p), (t2[1:], p2[1:])], r) for k, ((t, p, r), (t2, p2, _)) in enumerate(zip(first, later, strict=True))]
    items = spark.createDataFrame(list(enumerate(item_texts)), "item_id long, text string")
    want = brute_leaks(doc_rows, item_rows)
    for limit in (200_000, 0):
        got = {(r["doc_id"], r["item_id"]) for r in template_decontam.leaks(docs(texts), items, broadcast_windows=limit).collect()}
        assert got == want
    assert 40 < len(want) < len(texts) * len(item_texts) / 3


def brute_lines(texts, least=5):
    lines = [((d, k), tuple(x.encode().split())) for d, t in enumerate(texts) if t for k, x in enumerate(t.split("\n"))]
    lines = [(at, w) for at, w in lines if w]

    def near(a, b):
        if min(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    first = {}
    for at, w in lines:
        first.setdefault(w, at)
    out = {}
    for at, w in lines:
        if first[w] != at:
            out[at] = (first[w], 0)
        elif before := [o for v, o in first.items() if o < at and near(v, w)]:
            out[at] = (min(before), 1)
    return out


def test_lines(docs):
    rng = random.Random(6)
    base = [[rng.choice("abcdef") for _ in range(rng.choice([3, 4, 5, 6, 9, 30]))] for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 1)] = rng.choice([[], ["zz"], ["a"]])
                w = w or ["q"]
            lines.append(rng.choice(["", " "]) + rng.choice([" ", "\t "]).join(w))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", " \n x", "long " * 3000, "long " * 2999 + "end"]
    for heavy_k in (2, 512):
        got = {(r["doc_id"], r["line_no"]): ((r["keep_doc_id"], r["keep_line_no"]), r["edits"]) for r in line_dedup.dropped_lines(docs(texts), heavy_k=heavy_k).collect()}
        assert got == brute_lines(texts)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(["a b\nc", "c\na  b\nd", None])).collect()}
    assert kept == {0: "a b\nc", 1: "d", 2: None}
    assert line_dedup.dropped_lines(docs([])).count() == 0


def test_lines_of_repeated_ids_stay_apart(docs):
    texts = ["first line of all here\nkeep me here please now", "first line of this one\nfirst line of all here", "first line of all here\nkeep me here please now", "keep me here please now"]
    for id_ in (5, None):
        out = line_dedup.dedup_lines(docs(texts[:2], ids=[id_, id_])).collect()
        lines = [x for r in out for x in r["text"].split("\n")]
        assert lines.count("keep me here please now") == 1 and len([x for x in lines if x == "first line of all here"]) == 1
    kept = sorted(r["text"] for r in line_dedup.dedup_lines(docs(texts[2:], ids=[5, 6])).collect())
    assert kept == ["", texts[0]]

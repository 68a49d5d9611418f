import random

import corpus_pipeline
from graphloom.llm import jaccard, langid, simhash


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = random.Random(8)
    vocab = {"en": "the of and to in that was with reading house".split(), "de": "der die und zu nicht über größe schon haus".split()}
    texts, langs = [], []
    for k in range(160):
        langs.append("en" if k % 3 else "de")
        texts.append(" ".join(rng.choice(vocab[langs[-1]]) + str(rng.randrange(50)) for _ in range(60)))
    item = " ".join(f"question{c} word" for c in "abcdefghijkl")
    texts[7] += " " + item
    texts += [texts[3], texts[3] + " ", None, "", "123"]
    langs += ["de", "de", None, "en", None]
    docs = spark.createDataFrame([(k, t, c, f"s{k % 4}", len(t or "")) for k, (t, c) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert docs.columns == before.columns
        seen[name] = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert seen["language"] == list(range(162))
    assert seen["near_duplicates"] == [k for k in range(161 + 1) if k not in (3, 160)]  # the longest of three stays
    assert seen["decontaminate"] == [k for k in seen["near_duplicates"] if k != 7]
    assert set(seen["mix"]) <= set(seen["decontaminate"]) and len(seen["mix"]) > len(seen["decontaminate"])
    assert seen["tokens"] == seen["mix"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["tokens"])


def test_drop_duplicates_with_repeated_rows(docs):
    out = simhash.drop_duplicates(docs(["a b c", "a b c", "other text", None, ""], ids=[1, 1, 1, None, 2])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("1", "a b c"), ("1", "other text"), ("2", "")]


def test_empty_table(spark, docs):
    empty = docs([]).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        if name != "decontaminate":
            assert stage(spark, empty, "").count() == 0
    assert langid.fit(empty).labels == []


def test_near_duplicates_are_pairs_of_similar_five_word_shingles(docs, spark):
    rng = random.Random(11)
    base, texts = [f"w{k}" for k in range(150)], [None, "", "a b", "A  b"]
    for group in range(4):
        for _ in range(25):
            ws = [f"{w}x{group}" for w in base[: 150 - 30 * group]]
            for _ in range(rng.randint(0, 4)):
                ws[rng.randrange(len(ws))] = f"z{rng.random()}"
            texts.append(" ".join(ws))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
                far += ((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count()) > 3
    best = {}
    for k, t in enumerate(texts):
        best[find(k)] = min(best.get(find(k), (1, 0)), (-len(t or ""), k))
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs(texts), "").collect())
    assert got == sorted(k for _, k in best.values())
    assert far > 50 and 4 < len(best) < 60

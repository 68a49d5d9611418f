import hashlib
import random
from collections import Counter

import numpy as np

from graphloom.llm import recompress


def brute(texts, n=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = {}
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (34, 35, 36, 60, 200)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += text(rng.randint(0, 50)) + rng.choice(passages)
        docs.append(" ".join(parts))
    docs += [docs[0]] * 3 + [" \n\t".join(docs[1].split()), None, "", "a " * 34, "b " * 35, "c " * 36, "c " * 400, "d e " * 90, "x y z " * 11 + "x y", "x y z " * 11 + "x y"]
    return docs


def test_equals_brute_force(docs):
    for seed in range(3):
        texts = corpus(seed)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompress.substring_dedup(docs(texts)).collect()}
        assert got == brute(texts)
    assert recompress.substring_dedup(docs([])).count() == 0


def test_repeated_rows_and_kept_text(docs):
    t = " ".join(map(str, range(50)))
    got = recompress.substring_dedup(docs([t, t, t + " end", "short text"], ids=[4, 4, 5, 6])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in got) == [(4, 50, ""), (4, 50, ""), (5, 50, "end"), (6, 0, "short text")]


def test_equal_windows_share_their_key():
    rng = random.Random(9)
    for _ in range(300):
        window = [rng.choice(["a", "b", "c", "dd"]).encode() for _ in range(35)]
        keys = set()
        for _ in range(2):
            before, after = ([rng.choice(["a", "b", "c", "e"]).encode() for _ in range(rng.randint(0, 12))] for _ in range(2))
            names = recompress.name_words(before + window + after)
            doc = np.zeros(len(names), int)
            start, _, key = recompress.anchors(names, doc, recompress._valid(doc, 35))
            keys.add(int(key[start == len(before)][0]))
        assert len(keys) == 1

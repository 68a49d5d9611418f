"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-cased letters with single spaces between words; their 1- to 3-grams are hashed
to ``DIM`` features with weight (1 + log tf) * idf, scaled to length 1.  Document frequencies come
from all training documents.  The weights are trained with follow-the-regularised-leader
(proximal, per coordinate) under an elastic-net penalty on at most ``max_train`` documents, evenly
over the languages by a seeded hash of the id, and a temperature fitted on a fifth of
those calibrates the probabilities.

Defined results: a null id counts as an empty text in the split; a null text, or one without letters, is ``und`` with score 0; with no labelled
rows everything is; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 1 << 15
ORDERS = (1, 2, 3)
_lut: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    global _lut
    if _lut is None:
        _lut = np.full(0x110000, 32, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                _lut[cp] = ord(c.lower()[0])
    return _lut


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed features of a text and how often each occurs; None without letters."""
    x = _letters()[np.frombuffer((text or "").encode("utf-32-le"), "<u4")]
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    x = x[np.r_[True, (x[1:] != 32) | (x[:-1] != 32)]]
    if len(x) < 2 or (x == 32).all():
        return None
    found, h = [], np.zeros(len(x), np.uint32)
    for n in ORDERS:
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * np.uint32(0x9E3779B1) + np.uint32(n)
        found.append((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(17))
    total = np.bincount(np.concatenate(found), minlength=DIM)
    index = np.flatnonzero(total)
    return index, total[index]


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0), np.float32))
    temperature: float = 1.0

    def vector(self, index: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (1 + np.log(n)) * self.idf[index]
        return x / math.sqrt(float(x @ x))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or (found := counts(text)) is None:
            return "und", 0.0
        p = softmax(self.vector(*found) @ self.weights[found[0]] / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 5, seed: int = 3) -> np.ndarray:
    """FTRL-proximal weights from (features, values, class) examples."""
    z, n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def at(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            i, x, y = examples[k]
            w = at(i)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            more = n[i] + g * g
            z[i] += g - (np.sqrt(more) - np.sqrt(n[i])) / alpha * w
            n[i] = more
    return at(np.arange(DIM)).astype(np.float32)


def calibrate(weights: np.ndarray, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> float:
    """The temperature with the least loss on held-out examples (golden section on its log)."""
    if not examples:
        return 1.0
    logits = np.array([x @ weights[i] for i, x, _ in examples])
    y = np.array([c for *_, c in examples])

    def loss(t: float) -> float:
        s = logits / math.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean())

    a, b, g = -4.0, 3.0, (math.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return math.exp((a + b) / 2)


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 2000, seed: int = 5, max_langs: int = 1000) -> Model:
    """Trains on the documents that are not held out and have a label."""
    rows = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(id_col).alias("id"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, langs = np.zeros(DIM + 1, np.int64), {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if (found := counts(text.as_py())) is not None:
                    total[found[0]] += 1
                    total[DIM] += 1
                    langs[lang] = langs.get(lang, 0) + 1
        index = np.flatnonzero(total)
        names = [None] * len(index) + list(langs)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([*index.tolist(), *[-1] * len(langs)], pa.int64()), pa.array([*total[index].tolist(), *langs.values()], pa.int64())], ["lang", "feature", "n"])

    sums = rows.select("text", "lang").mapInArrow(frequencies, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    df, found = np.zeros(DIM + 1), {}
    for r in sums.limit(DIM + 2 + max_langs).collect():  # bounded by the number of features and labels
        if r["feature"] < 0:
            found[r["lang"]] = r["n"]
        else:
            df[r["feature"]] = r["n"]
    if len(found) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    labels = sorted(found)
    model = Model(labels, np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1)
    if not labels:
        return model
    each = -(-max_train // len(labels))
    rate = F.create_map(*(F.lit(x) for c in labels for x in (c, min(1.0, 1.3 * each / found[c]))))
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, order, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (f := counts(text)) is not None:
                    out.append((lang, order, f[0].astype(np.uint16).tobytes(), f[1].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.string(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["lang", "order", "i", "n"])

    chosen = rows.select("lang", order.alias("order"), "text").where(F.col("order") < rate[F.col("lang")])
    got = sorted(tuple(r) for r in chosen.mapInArrow(sample, "lang string, order double, i binary, n binary").collect())  # about 1.3 * max_train rows
    used: dict[str, int] = dict.fromkeys(labels, 0)
    parts: tuple[list, list] = ([], [])
    for lang, _, i, n in got:
        if used[lang] < each:
            index = np.frombuffer(i, np.uint16).astype(np.int64)
            parts[used[lang] % 5 == 4].append((index, model.vector(index, np.frombuffer(n, np.uint32)), labels.index(lang)))
            used[lang] += 1
    model.weights = train(parts[0], len(labels))
    model.temperature = calibrate(model.weights, parts[1])
    return model


def predictor(docs: DataFrame, model: Model):
    """Column function: text -> struct(lang, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM x (labels + 1) numbers

    @F.pandas_udf("lang string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        m = sent.value
        return pd.DataFrame([m.predict(t) for t in text], columns=["lang", "score"])

    return predict


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The input with ``held_out, lang_pred, score``."""
    predict = predictor(docs, fit(docs, id_col, text_col, lang_col, **options))
    out = docs.withColumn("held_out", held_out(F.col(id_col))).withColumn("__p", predict(F.col(text_col)))
    return out.withColumn("lang_pred", F.col("__p.lang")).withColumn("score", F.col("__p.score")).drop("__p")

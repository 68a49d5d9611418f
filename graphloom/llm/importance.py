"""Quality selection by importance resampling.

Two generative models over hashed word 1- and 2-grams, one of target text (labelled good) and one
of all raw text, give each document a log importance weight: the sum of log p_target / p_raw over
its n-grams.  Adding seeded Gumbel noise and keeping the k largest samples k documents without
replacement in proportion to their weights.

Raw counts cover all documents; the target model is fitted on at most ``max_target`` labelled
documents (their ids are broadcast).  k is the labelled share of good documents times the number
of documents.  The k-th key is found exactly by refining histograms; no sort of all rows.

Defined results: null and empty texts have weight 0; rows with one id (null ids too) have one noise; ties at the cut go to the smaller
id, null last, then to arbitrary ones of the rows, so that exactly k rows stay; with no labels everything is kept; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import written

BUCKETS = 1 << 16
BINS = 4096


class _Names(dict):
    def __missing__(self, word: bytes) -> int:
        name = self[word] = xxhash.xxh64_intdigest(word, 29)
        return name


_names = _Names()


def grams(text: str | None) -> np.ndarray:
    """Buckets of the text's word 1- and 2-grams, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if len(_names) > 1_000_000:
        _names.clear()
    h = np.fromiter(map(_names.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xD6E8FEB86659FD95)
    return (np.concatenate([h, pairs]) >> np.uint64(48)).astype(np.int32)


def log_ratios(docs: DataFrame, targets: DataFrame, smooth: float = 1.0) -> np.ndarray:
    """log p_target / p_raw of each bucket; ``docs(doc_id, text)``, ``targets(doc_id)`` bounded."""
    marked = docs.join(F.broadcast(targets.withColumn("good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        held: tuple[list, list] = ([], [])
        n = 0

        def add() -> None:
            for k in (0, 1):
                if held[k]:
                    total[k] += np.bincount(np.concatenate(held[k]), minlength=BUCKETS)
                    held[k].clear()

        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                g = grams(text.as_py())
                held[0].append(g)
                if good:
                    held[1].append(g)
                if (n := n + len(g)) >= 1 << 20:
                    add()
                    n = 0
        add()
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])

    sums = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    n = np.full((2, BUCKETS), smooth)
    for r in sums.collect():  # at most BUCKETS rows
        n[:, r["bucket"]] += r["raw"], r["target"]
    p = n / n.sum(1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def kth_largest(keys: DataFrame, k: int, few: int = 2000) -> tuple[float, int]:
    """The k-th largest of ``keys(key double)``, and how many rows equal to it belong to the k.

    Histograms of ``BINS`` bins between the bounds of what is left, again until few distinct
    values are left; what is collected is bounded.
    """
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        within = keys.where(F.col("key").between(lo, hi))
        if lo == hi:
            return lo, k
        values = within.groupBy("key").count().orderBy(F.desc("key")).limit(few + 1).collect() if within.limit(few + 1).count() <= few else []
        if values:
            for r in values:
                if r["count"] >= k:
                    return r["key"], k
                k -= r["count"]
        width = (hi - lo) / BINS
        bin_ = F.least(F.floor((F.col("key") - lo) / width), F.lit(BINS - 1))
        for r in within.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy(F.desc("bin")).collect():
            if r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]


def first_tied(tied: DataFrame, n: int, step: int = 1000) -> Column:
    """Condition on ``(doc_id, row)`` for the first ``n`` of the rows ``tied(doc_id, row)``: by id, null last, then by row.

    ``row`` is a number unique among all rows, ``task << 33 | place``.  Ids are counted ``step`` at a time
    and tasks counted for one id; no list of rows is gathered.
    """
    ids = tied.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    last, id_ = None, F.col("doc_id")
    while True:
        more = ids if last is None else ids.where(F.col("doc_id").isNull() | (F.col("doc_id") > last))
        got = more.orderBy(F.asc_nulls_last("doc_id")).limit(step).collect()
        for r in got:
            if n <= r["n"]:
                before = id_.isNotNull() if r["doc_id"] is None else F.coalesce(id_ < r["doc_id"], F.lit(False))
                break
            n, last = n - r["n"], r["doc_id"]
        else:
            if len(got) < step:
                return F.lit(True)
            continue
        break
    own = tied.where(id_.eqNullSafe(F.lit(r["doc_id"])))
    task, place = F.shiftright("row", 33), F.col("row").bitwiseAND(F.lit((1 << 33) - 1))
    for t in own.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():  # one row for each task that wrote rows
        if n <= t["n"]:
            break
        n -= t["n"]
    cut, _ = kth_largest(own.where(task == t["task"]).select((-place).cast("double").alias("key")), n)
    here = (task < t["task"]) | ((task == t["task"]) & (place <= int(-cut)))
    return before | (id_.eqNullSafe(F.lit(r["doc_id"])) & here)


def select_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_target: int = 20_000, seed: int = 13) -> DataFrame:
    """One row per input row: ``doc_id, log_weight, gumbel_key, kept``.

    ``labels``: ``doc_id, quality, toxic``; targets are good and not toxic.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total, good = labels.agg(F.count("quality"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    targets = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    targets = written(targets.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_target), "targets")
    ratios = rows.sparkSession.sparkContext.broadcast(log_ratios(rows, targets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [round(float(ratios.value[grams(t.as_py())].sum()), 9) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "doc_id"), 11) + 0.5) / F.lit(float(1 << 53))
    scored = rows.mapInArrow(weigh, "doc_id long, log_weight double").withColumn("key", F.col("log_weight") - F.log(-F.log(u))).withColumn("row", F.monotonically_increasing_id())
    scored = written(scored, "scored")
    n = scored.count()
    k = round(n * good / total) if total else n
    if not 0 < k < n:
        return scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), F.lit(k >= n).alias("kept"))
    cut, ties = kth_largest(scored.select("key"), k)
    tied = scored.where(F.col("key") == cut).select("doc_id", "row")
    kept = (F.col("key") > cut) | ((F.col("key") == cut) & first_tied(tied, ties))
    return scored.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), kept.alias("kept"))

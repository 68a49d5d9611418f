"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within distance 3 have a middle point within 1 of one of them and within 2 of the
other.  Every fingerprint therefore emits the points of its ball of radius 1 (65, *inner*) and
those points at distance 2 whose two flipped bits lie in the same half (992, *outer*): of three
differing bits, two always lie in one half.  All inner members of a point are within 2 of each
other and every outer member is within 3 of every inner one, so linking each member to the
point's smallest inner member keeps exactly the components of the full relation, with no pairs
enumerated; each link is verified all the same.  A point's members are bounded by the ball (1,057).

Before that an exact filter drops fingerprints that cannot have a partner: of eight (or twelve) bit blocks,
three differing bits leave five (nine) untouched, so a partner shares a key of so many blocks.
Without it every document would shuffle 1,057 rows.

Defined results: null ids count as no id (a component of such rows only has a null component_id); null and empty texts have fingerprint zero and are linked like any other; texts
of fewer words than a shingle form one shingle; repeated rows share a fingerprint and are linked;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, release, written


#: Distinct fingerprints from which on the filter takes longer keys: at 2^30, one in 18 has a chance partner by eight blocks.
MANY = 1 << 30


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles, as an unsigned integer."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return h(joined, seed)
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], "<u8")
    return int(majority(hashes)[0])


def majority(hashes: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit number: each bit is 1 if set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        total += np.unpackbits(hashes[k : k + 8192].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def row_fingerprint(words: int = 3, seed: int = 42):
    """Column function: text -> fingerprint as a signed 64-bit integer."""

    @F.pandas_udf("long")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in text], "<u8").view("<i8"))

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, **extra: Column) -> DataFrame:
    """``(doc_id, fp)``, and ``extra`` columns by name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_fingerprint(words, seed)(F.col(text_col)).alias("fp"), *(c.alias(n) for n, c in extra.items()))


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_keys(blocks: int = 8, keep: int = 5) -> list[int]:
    """Masks of every choice of ``keep`` of ``blocks`` bit blocks of about the same size."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    return _signed([sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen) for chosen in combinations(range(blocks), keep)])


def ball() -> tuple[list[int], list[int]]:
    """Flip masks of the inner and of the outer points."""
    inner = [0, *(1 << i for i in range(64))]
    outer = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return _signed(inner), _signed(outer)


def candidates(fps: DataFrame, blocks: int | None = None) -> DataFrame:
    """Those of the distinct ``fps(fp)`` that share a key of all but three blocks with another one.

    Eight blocks (56 keys of 40 bits) up to ``MANY`` fingerprints, beyond that twelve (220 of 48 bits), so that
    chance partners stay rare; either is exact.  The join is shuffled at every size, so disk and network grow in proportion.
    """
    blocks = blocks or (8 if fps.count() <= MANY else 12)
    masks = F.array(*(F.lit(m) for m in block_keys(blocks, blocks - 3)))
    keyed = fps.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", "k", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    # a table of its own, so that the join may split a key that very many fingerprints have
    shared = written(keyed.groupBy("k", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("k", "key"), "shared")
    release(fps.sparkSession)
    return keyed.join(shared.hint("merge"), ["k", "key"], "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Verified links ``(a, b)`` that connect exactly what distance 3 or less connects."""
    inner, outer = ball()
    flips = F.explode(F.lit(inner + outer)).alias("flip")
    deep = len(inner)
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = fps.repartition(parts).select("fp", flips).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.bit_count("flip") < 2).alias("inner"))
    groups = points.groupBy("point").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("centre"), F.collect_list("fp").alias("members"))
    assert deep == 65
    pairs = groups.where(F.col("centre").isNotNull() & (F.size("members") > 1)).select(F.col("centre").alias("a"), F.explode("members").alias("b"))
    return pairs.where("a <> b and bit_count(a ^ b) <= 3").distinct()


def components(rows: DataFrame) -> DataFrame:
    """``rows(doc_id, fp, ...)`` with ``component_id``, the smallest id reachable over links."""
    spark = rows.sparkSession
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    near = written(candidates(fps.select("fp")), "candidates")
    release(spark)
    edges = written(links(near), "links")
    release(spark)
    roots = connected_components(edges)
    labelled = written(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "labelled")
    least = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = written(labelled.join(least, "root").select("fp", "root", "component_id"), "named")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``."""
    rows = written(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    return components(rows).select("doc_id", "fp", "component_id")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """The input with one row of each group of near-duplicates: the longest text, then the smallest
    id (null last), then any one of equal rows; all columns kept."""
    size = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    rows = written(fingerprints(docs, id_col, text_col, words, seed, size=size), "fingerprints")
    order = F.struct(-F.col("size"), F.col("doc_id").isNull(), "doc_id", "fp")
    best = components(rows).groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("__id"), F.col("w.fp").alias("__fp"))
    best = written(best, "winners")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(best, same, "left_semi")
    marked = docs.withColumn("__own", row_fingerprint(words, seed)(F.col(text_col)))
    own = marked.join(best, same & (F.col("__own") == F.col("__fp")), "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col, "__own").orderBy(F.desc(size)))
    return own.withColumn("__first", first).where("__first = 1").select(*docs.columns)

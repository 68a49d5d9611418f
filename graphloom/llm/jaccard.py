"""The similarity form of :mod:`simhash`: near copies by verified Jaccard similarity of word shingles.

Two texts are near copies when their sets of five-word shingles (lower-case, hashed to 64 bits) have
a similarity of 0.8 or more; groups are the components of that relation.  Texts with equal sets are
one *node*.  Candidates come from two searches and every link is verified on the sets:

* fingerprints of the sets within three bits of each other, by ball hashing;
* since a pair of similarity 0.8 differs in ten of 64 bits on average, also nodes that share one of 48
  keys of six minima each, every one with the smallest node of its key.  A pair of similarity 0.8
  shares no key with a probability under 1e-6, a closer pair with a smaller one.

What is left are keys whose nodes are still in several components.  Their nodes meet by an exact
prefix filter: with shingles ordered from rare to frequent, two sets of similarity 0.8 share one among
the first ``n - ceil(0.8 n) + 1`` of each.  Of a shingle's nodes only those outside its most frequent
component are compared with the others, and only where sizes, the places of the shingle in both
sets and the shingles' parity bits (256) leave room for a link, which loses none.  Near copies with
different words of their own hence never meet, however many of them share a key.

Defined results: null and empty texts are equal; texts of fewer words than a shingle form one
shingle; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import simhash
from graphloom.llm.common import connected_components, discard, release, small_batches, written

BANDS, MINIMA, BINS = 48, 6, 256
_rng = np.random.default_rng(42)
FACTORS = _rng.integers(0, 2**64, BANDS * MINIMA, "<u8") | np.uint64(1)
MIX = _rng.integers(0, 2**64, (BANDS, MINIMA), "<u8") | np.uint64(1)
SALT = _rng.integers(0, 2**64, BANDS, "<u8")


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    parts = (text or "").encode().lower().split()
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(joined, seed)], "<u8")
    ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    return np.unique(np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], "<u8"))


def sketch(found: np.ndarray) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Node, fingerprint, number of shingles, parity bits and band keys of a set of shingles."""
    least = np.full(BANDS * MINIMA, 2**64 - 1, "<u8")
    for k in range(0, len(found), 2048):
        np.minimum(least, (FACTORS[:, None] * found[None, k : k + 2048]).min(1), out=least)
    keys = (least.reshape(BANDS, MINIMA) * MIX).sum(1, dtype="<u8") ^ SALT
    parity = np.packbits(np.bincount((found % np.uint64(BINS)).astype(np.int64), minlength=BINS) % 2 == 1)
    node = np.array([xxhash.xxh64_intdigest(found.tobytes(), 7)], "<u8").view("<i8")[0]
    return int(node), simhash.majority(found).view("<i8").item(), len(found), parity.view("<i8"), keys.view("<i8")


def row_sketch(words: int):
    @F.pandas_udf("node long, fp long, n int, parity array<long>, keys array<long>")
    def run(text: pd.Series) -> pd.DataFrame:
        node, fp, n, parity, keys = zip(*(sketch(shingles(t, words)) for t in text), strict=True) if len(text) else ((),) * 5
        return pd.DataFrame({"node": node, "fp": fp, "n": n, "parity": parity, "keys": keys})

    return run


def row_shingles(words: int):
    @F.pandas_udf("array<long>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view("<i8") for t in text], dtype=object)

    return run


def _may(a: str, b: str) -> str:
    """Whether sizes and parity bits leave room for a similarity of 0.8: 9 * |a ^ b| <= |a| + |b|."""
    bits = " + ".join(f"bit_count({a}parity[{k}] ^ {b}parity[{k}])" for k in range(BINS // 64))
    return f"9 * greatest({bits}, abs({a}n - {b}n)) <= {a}n + {b}n"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have a similarity of 0.8 or more."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("found").alias(f"found_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    # shared / (|a| + |b| - shared) >= 4 / 5
    return both.where("9 * size(array_intersect(found_a, found_b)) >= 4 * (size(found_a) + size(found_b))").select("a", "b")


def prefixes(left: DataFrame, sets: DataFrame) -> DataFrame:
    """``(token, at, node, root, n, parity)``: each node's first shingles, rare ones first, that other
    nodes have too, with their places; ``left(node, root, n, parity)``."""
    each = written(left.select("node").join(sets, "node").select("node", F.explode("found").alias("token")), "tokens")
    often = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    found = each.join(often.hint("merge"), "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("order"))
    first = left.join(found, "node").withColumn("alone", F.col("n") - F.size("order"))
    # n - ceil(4 n / 5) + 1 shingles, those that no other node has before all others
    some = F.slice("order", 1, F.greatest(F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1 - F.col("alone"), F.lit(0)))
    out = written(first.select("node", "root", "n", "parity", "alone", F.posexplode(some).alias("k", "o")).select("o.token", (F.col("alone") + F.col("k") + 1).alias("at"), "node", "root", "n", "parity"), "prefixes")
    discard(each)
    discard(often)
    return out


def missed(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidates ``(a, b)`` of different roots among ``left(node, root, n, parity)``, none of similarity 0.8 left out."""
    first = prefixes(left, sets)
    release(left.sparkSession)
    # a table of its own, so that the join may split a shingle that very many nodes have
    sums = first.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = written(sums.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots"), "tops")
    both = written(first.join(tops.hint("merge"), "token"), "meeting")
    discard(first)
    discard(tops)
    release(left.sparkSession)
    x, y = both.where("root <> top").alias("x"), both.alias("y")
    room = f"""x.token = y.token and x.root <> y.root and (y.root = y.top or x.node < y.node)
               and 9 * (1 + least(x.n - x.at, y.n - y.at)) >= 4 * (x.n + y.n) and {_may("x.", "y.")}"""
    return x.hint("merge").join(y, F.expr(room)).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def components(rows: DataFrame, texts: DataFrame, words: int = 5) -> DataFrame:
    """``(node, root)`` of nodes with a partner; ``rows(node, fp, n, parity, keys, hash)``, ``texts(hash, text)``."""
    spark = rows.sparkSession
    nodes = written(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("keys").alias("keys"), F.min("hash").alias("hash")), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # tables of their own, so that joins may split a key that very many nodes have
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("hi")).where("centre <> hi").drop("hi"), "shared")
    release(spark)
    met = written(keyed.join(shared.hint("merge"), "key"), "met")
    discard(shared)
    release(spark)
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    close = written(simhash.links(written(simhash.candidates(prints.select("fp")), "candidates")), "close")
    release(spark)
    first = lambda c: prints.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}"))
    pairs = close.join(first("a"), "a").join(first("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    pairs = pairs.union(nodes.select("fp", "node").join(prints, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")))
    star = written(pairs.union(met.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b"))).distinct(), "star")
    release(spark)
    some = written(nodes.drop("keys", "fp").join(star.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "some")
    own = texts.join(some.select("node", "hash"), "hash").groupBy("node").agg(F.min("text").alias("text"))
    with small_batches(spark):
        sets = written(own.select("node", row_shingles(words)(F.col("text")).alias("found")), "sets")
    discard(nodes)
    release(spark)
    side = lambda x: some.select(F.col("node").alias(x), F.struct("n", "parity").alias(f"s{x}"))
    star = star.join(side("a"), "a").join(side("b"), "b").where(_may("sa.", "sb.")).select("a", "b")
    edges = written(verified(star, sets), "links")
    release(spark)
    roots = connected_components(edges)
    named = written(met.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    discard(met)
    mixed = written(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    left = named.join(mixed, "key", "left_semi").select("node", "root").distinct()
    left = written(left.join(some.select("node", "n", "parity"), "node"), "left")
    discard(named)
    release(spark)
    more = written(verified(missed(left, sets), sets), "links")
    release(spark)
    return roots if more.isEmpty() else connected_components(edges.union(more))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """The input with one row of each group of near copies: the longest text, then the smallest
    id (null last), then any one of equal rows; all columns kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, own = F.char_length(text), F.xxhash64(text)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), own.alias("hash"), row_sketch(words)(F.col(text_col)).alias("s"))
    with small_batches(docs.sparkSession):
        rows = written(rows.select("doc_id", "size", "hash", "s.*"), "sketches")
    roots = components(rows, docs.select(own.alias("hash"), text.alias("text")), words)
    named = rows.select("doc_id", "size", "hash", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    order = F.struct(-F.col("size"), F.col("doc_id").isNull(), "doc_id", "hash")
    best = named.groupBy("root").agg(F.min(order).alias("w")).select(F.col("w.doc_id").alias("__id"), F.col("w.hash").alias("__hash"))
    best = written(best, "winners")
    kept = docs.join(best, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (own == F.col("__hash")), "left_semi")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(id_col, "__own").orderBy(F.desc(size)))
    return kept.withColumn("__own", own).withColumn("__first", first).where("__first = 1").select(*docs.columns)

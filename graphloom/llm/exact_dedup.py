"""Exact deduplication with a heavy-hitter split (built-in functions only).

A bounded Misra-Gries summary (``approx_top_k``) names the digests that may hold a large share
of all rows.  Their exact winners are aggregated with map-side combining, and, being at most
``heavy_k`` rows, broadcast, so hot groups never cross the network.  All other digests, each
below the share, go through one ordinary shuffle.

Defined results: a null text counts as empty; empty texts equal each other; of equal texts the
row with most code points, then the smallest id (null last) stays; of wholly repeated rows one
stays; other input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy_k: int = 512, tracked: int = 8192) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A digest is heavy from a share of ``1 / heavy_k`` of all rows, so at most ``heavy_k``
    digests are; ``tracked`` bounds the summary.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.regexp_replace(text, SPACE, ""), 256)).alias("sha"), F.char_length(text).alias("len"), F.monotonically_increasing_id().alias("row")), "digests")
    key = F.xxhash64("sha")
    total, top = rows.select(F.count(F.lit(1)), F.expr(f"approx_top_k(xxhash64(sha), {heavy_k}, {tracked})")).first()
    found = [x["item"] for x in top or [] if x["count"] * heavy_k >= total and x["count"] > 1]
    best = F.struct(F.col("len"), F.col("id").isNotNull(), -F.col("id"), F.col("row"))
    heavy = (
        rows.where(key.isin(found) if found else F.lit(False))
        .groupBy("sha").agg(F.max(best).alias("w"), F.count(F.lit(1)).alias("size"))
        .where(F.col("size") * heavy_k >= total)
        .select("sha", "size", (-F.col("w").getField("col3")).alias("keep_id"), F.col("w").getField("row").alias("keep_row"))
    )
    marked = rows.join(F.broadcast(heavy), "sha", "left")
    out = ("id", "keep_id", "size", "kept", "sha")
    hot = marked.where(F.col("size").isNotNull()).withColumn("kept", F.col("row") == F.col("keep_row")).select(*out)
    group = Window.partitionBy("sha")
    order = group.orderBy(F.desc("len"), F.asc_nulls_last("id"))
    rest = (
        marked.where(F.col("size").isNull()).drop("keep_id", "size")
        .withColumn("keep_id", F.first("id").over(order)).withColumn("kept", F.row_number().over(order) == 1)
        .withColumn("size", F.count(F.lit(1)).over(group)).select(*out)
    )
    return hot.union(rest).select(F.col("id").alias("doc_id"), "keep_id", F.col("size").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))

"""Source maps: decoding, offsets, placing in modules, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import slices

DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def vlq(segment: Column) -> Column:
    """The numbers of a base-64 VLQ segment, as array<bigint>; foreign characters count as 0."""
    zero = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("shift"))

    def add(s: Column, c: Column) -> Column:
        digit = F.greatest(F.call_function("instr", F.lit(DIGITS), c) - 1, F.lit(0))
        value = s["value"] + F.call_function("shiftleft", digit.bitwiseAND(F.lit(31)).cast("bigint"), s["shift"])
        more = digit.bitwiseAND(F.lit(32)) != 0
        number = F.when(value.bitwiseAND(F.lit(1)) == 1, -F.shiftright(value, 1)).otherwise(F.shiftright(value, 1))
        return F.struct(
            F.when(more, s["out"]).otherwise(F.concat(s["out"], F.array(number))).alias("out"),
            F.when(more, value).otherwise(F.lit(0).cast("bigint")).alias("value"), F.when(more, s["shift"] + 5).otherwise(F.lit(0)).alias("shift"),
        )

    return F.aggregate(F.filter(F.split(segment, ""), lambda c: c != ""), zero, add, lambda s: s["out"])


def decode(maps: DataFrame, key: str = "map_id") -> DataFrame:
    """``(map_id, gen_line, seg, gen_col, source_idx, source_line, source_col, name_idx)``.

    Columns restart on each line; the other fields run on over the whole map.  Only segments of 4 or
    more fields give rows, but shorter ones move the column.
    """
    lines = maps.select(key, F.posexplode(F.split("mappings", ";")).alias("gen_line", "line")).where("line <> ''")
    segs = lines.select(key, "gen_line", F.posexplode(F.split("line", ",")).alias("seg", "text")).where("text <> ''").withColumn("v", vlq(F.col("text")))
    line = Window.partitionBy(key, "gen_line").orderBy("seg")
    whole = Window.partitionBy(key).orderBy("gen_line", "seg")
    # only deltas of full segments count for the fields that run on
    full = F.size("v") >= 4
    at = lambda k: F.coalesce(F.try_element_at("v", F.lit(k + 1)), F.lit(0))
    run = lambda k, w, ok=None: F.sum(at(k) if ok is None else F.when(ok, at(k)).otherwise(0)).over(w)
    rows = segs.select(
        key, "gen_line", "seg", run(0, line).alias("gen_col"), run(1, whole, full).alias("source_idx"), run(2, whole, full).alias("source_line"), run(3, whole, full).alias("source_col"),
        F.when(F.size("v") >= 5, run(4, whole, F.size("v") >= 5)).alias("name_idx"), full.alias("full"),
    )
    return rows.where("full").drop("full")


def line_offsets(bundles: DataFrame, key: str = "map_id") -> DataFrame:
    """``(map_id, gen_line, line_start)``: where each line of the text starts."""
    lines = bundles.select(key, F.posexplode(F.split("code", "\n")).alias("gen_line", "line"))
    w = Window.partitionBy(key).orderBy("gen_line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select(key, "gen_line", F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).alias("line_start"))


def range_join(points: DataFrame, ranges: DataFrame, key: list[str], bucket: int = 1 << 14) -> DataFrame:
    """Points with the last-starting range that holds them: ``start <= offset < end``.

    Both sides are cut into buckets of offsets, so the join is an equi-join; a range appears once for
    each bucket that it touches.  Equal points stay separate rows.
    """
    at = points.withColumn("__b", F.floor(F.col("offset") / bucket))
    cover = ranges.where("end > start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    j = at.join(cover, [*key, "__b"]).where("offset >= start and offset < end")
    last = Window.partitionBy(*key, *(c for c in points.columns if c not in key)).orderBy(F.desc("start"), "range_id")
    return j.withColumn("__r", F.rank().over(last)).where("__r = 1").drop("__r", "__b")


def source_votes(placed: DataFrame, by: list[str]) -> DataFrame:
    """Mode of ``source`` per module; ties go to the source seen first (``ord``)."""
    n = placed.groupBy(*by, "source").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return n.groupBy(*by).agg(F.max_by("source", F.struct("n", -F.col("first"))).alias("source"), F.sum("n").alias("votes"))


def identifier_at(code: Column, offset: Column) -> Column:
    """The identifier that starts at an offset, or ''."""
    return F.regexp_extract(F.substring(code, offset + 1, F.lit(100)), r"^[a-zA-Z_$][a-zA-Z0-9_$]*", 0)


def base_name(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def enrich(modules: DataFrame, maps: DataFrame, bundles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(modules, identifiers)`` enriched from source maps; ``bkg_id`` is the key everywhere.

    ``maps(bkg_id, sources, names, mappings)``, ``bundles(bkg_id, code)``.
    """
    key = "bkg_id"
    points = decode(maps, key).join(line_offsets(bundles, key), [key, "gen_line"]).withColumn("offset", F.col("line_start") + F.col("gen_col"))
    points = points.join(maps.select(key, "sources", "names"), key).select(key, "gen_line", "seg", "offset", F.try_element_at("sources", (F.col("source_idx") + 1).cast("int")).alias("source"), F.try_element_at("names", (F.col("name_idx") + 1).cast("int")).alias("original"))
    ranges = modules.select(key, F.col("id").alias("range_id"), F.col("range.charStart").alias("start"), F.col("range.charEnd").alias("end"))
    placed = range_join(points, ranges, [key])
    order = F.struct("gen_line", "seg")
    votes = placed.where("source is not null").withColumn("ord", F.dense_rank().over(Window.partitionBy(key).orderBy(order)))
    best = source_votes(votes, [key, "range_id"]).select(key, F.col("range_id").alias("id"), "source")
    open_ = ~(F.coalesce("semantic_name", F.lit("")) != "") | F.col("semantic_source").eqNullSafe("propagation")
    hit = F.col("source").isNotNull()
    renamed = modules.join(best, [key, "id"], "left").withColumns({
        "source_file": F.coalesce("source", "source_file"), "semantic_name": F.when(hit & open_, base_name(F.col("source"))).otherwise(F.col("semantic_name")),
        "semantic_confidence": F.when(hit & open_, F.lit(0.95)).otherwise(F.col("semantic_confidence")), "semantic_source": F.when(hit & open_, F.lit("source_map_file")).otherwise(F.col("semantic_source")),
    }).select(*modules.columns)
    # a bundle's points are cut out of its text at once, so that the text does not travel with each
    per = placed.where("original is not null").groupBy(key).agg(F.collect_list(F.struct(F.col("offset").cast("int").alias("offset"), "range_id", "original", "gen_line", "seg")).alias("p"))
    cut = slices()("code", "p.offset", F.transform("p.offset", lambda x: x + 100))
    spots = bundles.select(key, "code").join(per, key).select(key, F.explode(F.arrays_zip("p", cut.alias("text"))).alias("z")).select(key, "z.p.*", "z.text")
    idents = spots.withColumn("minified", identifier_at(F.col("text"), F.lit(0))).where("minified <> ''")
    idents = idents.groupBy(key, F.col("range_id").alias("module"), "minified", F.col("original").alias("semantic")).agg(F.min(order).alias("at"))
    return renamed, idents.select(key, F.concat(F.lit("var:"), "module", F.lit(":"), "minified").alias("id"), "module", "minified", "semantic", F.lit("semantic").alias("state"), F.lit(1.0).alias("confidence"), F.lit("source_map").alias("source"))

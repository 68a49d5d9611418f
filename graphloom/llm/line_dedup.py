"""Line deduplication by a deletion-neighbourhood join (built-in functions only).

Lines are sequences of words; the bound is one word put in, taken out or replaced, for lines of at
least ``least_words`` words (at five, a similarity of 0.8); shorter lines match exactly only.
A line emits the hashed keys of all variants with one word deleted and of itself:

* two lines of equal length with one variant, deleted at one place, differ in that word alone;
* a line that equals a variant of a longer one differs by the word put in.

So the members of a key are related through it with no pairs listed: each needs only the key's
earliest member, found by a pre-aggregated minimum.  The pair that decides is verified word by word.
Variant keys take one pass of running exclusive-ors over the words, however long a line is.

An exact filter first drops lines that cannot have a partner: one edit leaves the first or the last
half of the longer line untouched, so partners share one of four half keys.

A line is dropped when an earlier one (by doc_id, then text, then line number) lies within the bound.

Defined results: blank lines and null texts are never dropped; lines that differ in white space only
are equal; a document is an id and a text: rows that repeat both are one and lose the same lines, equal ids
(or null ids) with other texts are separate and ordered by a hash of the text; null ids come first; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import SPACE, discard, release, written


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(at, line)`` of every line with words, these joined by one space; ``at`` orders lines: (doc_id, own, line_no),
    ``own`` being the hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("own"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    line = F.col("line")
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\r\x0b\x0c":
        odd = odd | line.contains(c)
    normal = F.when(odd, F.trim(F.regexp_replace(line, SPACE, " "))).otherwise(line)
    return rows.select(F.struct("doc_id", "own", "line_no").alias("at"), normal.alias("line")).where("line <> ''")


def half_keys(line: str, n: str) -> Column:
    """Keys of the halves at which a partner of as many, one more or one fewer words is equal."""
    keys = []
    for m in (n, f"({n} + 1)"):
        keys += [F.expr(f"xxhash64({m}, 0, substring_index({line}, ' ', {m} div 2))"), F.expr(f"xxhash64({m}, 1, substring_index({line}, ' ', -({m} - {m} div 2)))")]
    return F.array(*keys)


def variants(lines: DataFrame) -> DataFrame:
    """``(at, key, whole)``: keys of the line itself and of each line with one word deleted.

    ``whole``: null for same-place keys, true for the line itself, false for its deletions.
    """
    each = lines.select("at", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    here, moved = F.xxhash64("word", "pos"), F.xxhash64("word", F.col("pos") - 1)
    line = Window.partitionBy("at")
    upto = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select("at", "n", "pos", here.alias("here"), moved.alias("moved"))
    sums = sums.withColumn("a", F.bit_xor("here").over(upto)).withColumn("b", F.bit_xor("moved").over(upto)).withColumn("all", F.bit_xor("moved").over(line))
    # words before the deleted one keep their places, words after it move up by one
    variant = F.col("a").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all")).bitwiseXOR(F.col("b"))
    keys = F.array(
        F.struct(F.xxhash64(F.lit(2), "n", "pos", variant).alias("key"), F.lit(None).cast("boolean").alias("whole")),
        F.struct(F.xxhash64(F.lit(1), F.col("n") - 1, variant).alias("key"), F.lit(False).alias("whole")),
        F.when(F.col("pos") == F.col("n") - 1, F.struct(F.xxhash64(F.lit(1), "n", F.col("a")).alias("key"), F.lit(True).alias("whole"))),
    )
    return sums.select("at", F.explode(keys).alias("k")).where("k is not null").select("at", "k.key", "k.whole")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one word put in, taken out or replaced."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
    tail = lambda x, k: F.slice(x, k, F.size(x) + 1)
    return (differs > 0) & F.when(F.size(a) == F.size(b), tail(a, differs + 1) == tail(b, differs + 1)).when(F.size(a) == F.size(b) + 1, tail(a, differs + 1) == tail(b, differs)).when(F.size(a) + 1 == F.size(b), tail(a, differs) == tail(b, differs + 1)).otherwise(False)


def able_lines(first: DataFrame, least_words: int) -> DataFrame:
    """``at`` of the first occurrences that share a half with another line."""
    halves = first.where(F.col("n_words") >= least_words).select("at", "h1", F.explode("halves").alias("half"))
    # a table of its own, so that the join may split a half that very many lines have
    shared = written(halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half"), "shared")
    release(first.sparkSession)
    return written(halves.select("at", "half").join(shared, "half", "left_semi").select("at").distinct(), "able")


def near_lines(lines: DataFrame, able: DataFrame) -> DataFrame:
    """``(at, keep)``: for the lines ``able``, the earliest line within one edit, if earlier.

    Joins that bring words back are shuffled at every size, so disk and network grow in proportion.
    """
    spark = lines.sparkSession
    some = lines.join(able.hint("merge"), "at").dropDuplicates(["at"])
    some = written(some.select("at", F.split("line", " ").alias("words")), "some")
    discard(able)
    release(spark)
    keys = written(variants(some), "variants")
    release(spark)
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("whole").isNull(), F.col("at"))).alias("same"), F.min(F.when(F.col("whole"), F.col("at"))).alias("whole_at"), F.min(F.when(~F.col("whole"), F.col("at"))).alias("short_at"))
    met = written(met.where("n > 1").drop("n"), "met")  # likewise
    release(spark)
    other = F.when(F.col("whole").isNull(), F.col("same")).when(F.col("whole"), F.col("short_at")).otherwise(F.col("whole_at"))
    pairs = written(keys.join(met, "key").select("at", other.alias("keep")).where("keep < at").distinct(), "pairs")
    discard(keys)
    discard(met)
    release(spark)
    words = some.select(F.col("at").alias("keep"), F.col("words").alias("other"))
    checked = pairs.hint("merge").join(some, "at").hint("merge").join(words, "keep").where(one_edit(F.col("words"), F.col("other")))
    return checked.groupBy("at").agg(F.min("keep").alias("keep"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per dropped line: ``doc_id, line_no, keep_doc_id, keep_line_no, edits``."""
    return repeats(docs, id_col, text_col, **options).select("at.doc_id", F.col("at.line_no").cast("long").alias("line_no"), F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line_no").cast("long").alias("keep_line_no"), "edits")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 5, heavy_k: int = 512) -> DataFrame:
    """``(at, keep, edits)``: the place of each dropped line and of the line that it repeats."""
    lines = lines_of(docs, id_col, text_col)
    n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    sized = lines.withColumn("n_words", n)
    hashed = sized.select("at", "n_words", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), half_keys("line", "n_words").alias("halves"))
    wide = written(hashed, "lines")
    # equal lines have equal halves, so any row's will do
    first = written(wide.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words"), F.max("halves").alias("halves")), "first")
    release(docs.sparkSession)
    slim = written(wide.select("at", "h1", "h2"), "slim")
    discard(wide)
    again = written(first.where("n > 1").select("h1", "h2", "n", F.col("at").alias("keep")), "again")
    able = able_lines(first, least_words)
    discard(first)
    release(docs.sparkSession)
    near = near_lines(lines, able)
    total = slim.count()
    heavy = F.col("n") * heavy_k >= total  # at most heavy_k lines
    part = slim.join(F.broadcast(again.where(heavy).select("h1", "h2", "keep")), ["h1", "h2"], "left")
    exact = part.where("keep is not null").select("at", "keep").union(part.where("keep is null").drop("keep").join(again.where(~heavy), ["h1", "h2"]).select("at", "keep")).where("at <> keep")
    return exact.withColumn("edits", F.lit(0)).union(near.withColumn("edits", F.lit(1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with their dropped lines taken out of the text."""
    gone = repeats(docs, id_col, text_col, **options).groupBy(F.col("at.doc_id").alias("__id"), F.col("at.own").alias("__own")).agg(F.collect_set("at.line_no").alias("__gone"))
    joined = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__own")), "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, k: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<int>")), k))
    return joined.withColumn(text_col, F.array_join(kept, "\n")).drop("__id", "__own", "__gone")

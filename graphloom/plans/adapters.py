"""Views of the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.schema import to_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def module_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as modules: lines are the strings, their sizes the fingerprint."""
    d = table(spark, sf_dir, "documents")
    strings = F.array_sort(F.array_distinct(F.filter(lines(F.col("text")), lambda s: F.length(s).between(2, 200))))
    shape = F.array_join(F.transform(lines(F.col("text")), lambda s: F.floor(F.length(s) / 100).cast("string")), ":")
    odd = F.col("doc_id") % 3 == 0
    return d.select(
        F.col("doc_id").alias("ord"), F.concat(F.lit("mod:"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("minified_name"),
        F.when(odd, F.concat("lang", F.lit("_"), "source")).alias("semantic_name"), F.when(odd, (F.col("doc_id") % 10) / 10.0).alias("semantic_confidence"), F.when(odd, F.lit("given")).alias("semantic_source"), F.when(odd, F.col("source")).alias("source_file"),
        F.col("lang").alias("wrapKind"), "source", F.col("n_chars").alias("bytes"), F.size(lines(F.col("text"))).alias("stmtCount"), strings.alias("strings"), shape.alias("ast_fingerprint"), "text",
    )


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Targets (even ids) and references (odd ids)."""
    m = module_docs(spark, sf_dir).drop("text")
    return m.where("ord % 2 = 0"), m.where("ord % 2 = 1")


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of a graph of documents, each without some of the other's, changed here and there; together they hold all."""
    m = module_docs(spark, sf_dir).drop("text").withColumn("deps_out", F.transform(F.array(F.col("ord") + 1, F.col("ord") * 2), lambda x: F.concat(F.lit("mod:"), x.cast("string"))))
    a = m.where("ord % 5 <> 0")
    moved = F.col("ord") % 4 == 1
    b = m.where("ord % 7 <> 0 or ord % 5 = 0").withColumns({
        "semantic_name": F.when(moved, F.concat(F.lit("new_"), "wrapKind")).otherwise(F.col("semantic_name")), "semantic_confidence": F.when(moved, F.lit(0.5)).otherwise(F.col("semantic_confidence")),
        "bytes": F.when(F.col("ord") % 6 == 1, F.col("bytes") * 2).otherwise(F.col("bytes")), "deps_out": F.when(F.col("ord") % 8 == 1, F.reverse("deps_out")).otherwise(F.col("deps_out")), "strings": F.concat("strings", F.array("wrapKind")),
    })
    return a, b


def graph_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both versions as graph documents of 20 modules, with identifiers, annotations and an enrichment."""
    null = lambda t: F.lit(None).cast(t)
    block = lambda c: F.concat(F.lit("g"), F.floor(c / 20).cast("string")).alias("bkg_id")

    def documents(rows: DataFrame, shift: int) -> DataFrame:
        filled = rows.withColumns({"bkg_id": block(F.col("ord")), "range": null("struct<startLine:int,endLine:int,charStart:int,charEnd:int>"), "exports": F.array().cast("array<string>"), "deps_in": F.array().cast("array<string>")})
        d = table(spark, sf_dir, "documents").where(F.col("doc_id") % (5 + shift) != 0)
        state = F.when(F.col("doc_id") % 3 == shift, "semantic").when(F.col("doc_id") % 3 == 2, "placeholder").otherwise("raw")
        ident = F.struct(F.concat(F.lit("var:"), F.col("doc_id").cast("string")).alias("id"), null("string").alias("module"), F.col("lang").alias("minified"), F.col("source").alias("semantic"), state.alias("state"), ((F.col("doc_id") * (3 + shift)) % 7 / 7.0).alias("confidence"), null("string").alias("source"), null("string").alias("role"))
        note = F.struct(F.lit("note").alias("type"), F.col("source").alias("module"), F.lit(shift).alias("line"), null("string").alias("text"), null("string").alias("origin"))
        own = d.groupBy(block(F.col("doc_id"))).agg(F.array_sort(F.collect_list(ident)).alias("i"), F.array_sort(F.collect_list(F.when(F.col("doc_id") % 4 == shift, note))).alias("n"))
        info = filled.select("bkg_id").distinct().withColumn("bundle", F.struct(F.col("bkg_id").alias("file"), null("string").alias("version"), null("string").alias("bundler"), null("int").alias("size_bytes"), null("int").alias("total_modules"), null("int").alias("total_statements"), null("string").alias("hash_sha256")))
        graphs = to_graph(info, filled).join(own, "bkg_id", "left")
        log = F.array(F.struct(null("string").alias("timestamp"), F.lit(f"side{shift}").alias("technique"), null("string").alias("reference_version"), F.lit(0).alias("modules_enriched"), F.lit(0).alias("identifiers_enriched"), null("string").alias("provenance")))
        return graphs.withColumns({"identifiers": F.coalesce("i", "identifiers"), "annotations": F.coalesce("n", "annotations"), "enrichments": log}).drop("i", "n")

    a, b = versions(spark, sf_dir)
    return documents(a, 0), documents(b, 1)


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (part, supplier) edges."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("g").alias("bkg_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).distinct()


def customer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse directed graph over customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    to = F.explode(F.array(F.col("k") * 2, F.col("k") * 3 + 1))
    return c.select(F.lit("g").alias("bkg_id"), F.col("k").alias("src"), to.alias("dst")).join(c.select(F.col("k").alias("dst")), "dst").select("bkg_id", "src", "dst")


def turn_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as statements: they define their first word and use the others."""
    words = F.split("text", " ")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("bundle_id"), F.col("turn").cast("int").alias("ord"), F.array(F.element_at(words, 1)).alias("names"), F.array_distinct(words).alias("refs"), F.length("text").alias("bytes"),
        F.when(F.col("role") == "user", F.when(F.length("text") % 3 == 0, "CJS").otherwise("None")).otherwise(F.when(F.length("text") % 5 == 0, "ESM").otherwise("None")).alias("kind"), "role",
    )


def document_ranges(spark: SparkSession, sf_dir: str, blocks: int = 64) -> DataFrame:
    """``(k, range_id, start, end)``: the place of each document's text in the run of its block's texts."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % blocks).alias("k"), F.col("doc_id").alias("range_id"), "n_chars")
    upto = F.sum("n_chars").over(Window.partitionBy("k").orderBy("range_id"))
    return d.select("k", "range_id", (upto - F.col("n_chars")).alias("start"), upto.alias("end"))


def event_offsets(spark: SparkSession, sf_dir: str, blocks: int = 64) -> DataFrame:
    """Offsets over the whole length of each block's texts."""
    total = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % blocks).alias("k")).agg(F.sum("n_chars").alias("total"))
    e = table(spark, sf_dir, "events").select((F.col("event_id") % blocks).alias("k"), "event_id")
    return e.join(total, "k").select("k", "event_id", (F.col("event_id") * 7919 % F.col("total")).alias("offset"))


HELPERS = {"y": "var y=(a,b)=>()=>(b||a((b={exports:{}}).exports,b),b.exports);", "u": "var u=(a,b)=>()=>(a&&(b=a(a=0)),b);", "p0": "var p0=Object.create;"}


def turn_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as bundles ``(bundle_id, code)``: helpers (some conversations have one or none), then a
    statement for each turn: users' are module factories, assistants' functions that use the turn before, others' calls."""
    k, conv = F.col("turn").cast("string"), F.col("conv_id")
    word = F.substring(F.regexp_replace("text", "[^a-z]", ""), 1, 12)
    stmt = (
        F.when(F.col("role") == "user", F.concat(F.lit("var m"), k, F.lit('=y((e,m)=>{var s="'), word, F.lit('";m.exports=s});')))
        .when(F.col("role") == "assistant", F.concat(F.lit("function f"), k, F.lit("(a){return m"), (F.col("turn") - 1).cast("string"), F.lit('&&a?new Map:"'), word, F.lit('"}')))
        .otherwise(F.concat(F.lit("init"), k, F.lit('("'), word, F.lit('");')))
    )
    turns = table(spark, sf_dir, "conversations").groupBy(conv.alias("bundle_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", stmt.alias("s")))), lambda x: x["s"]).alias("t"))
    b = F.col("bundle_id") % 4
    head = F.array_compact(F.array(F.when(b != 3, HELPERS["y"]), F.when(b < 2, HELPERS["u"]), F.lit(HELPERS["p0"])))
    return turns.select("bundle_id", F.array_join(F.concat(head, "t"), "\n").alias("code"))


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page's first script element."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("bundle_id"), F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1).alias("code"))

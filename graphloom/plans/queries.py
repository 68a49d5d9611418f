"""One registered query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.functions import text
from graphloom.operators import align, boundary, chain, features, graph, infer, match, ops, profile, rename, report, similarity, sourcemap, unpack
from graphloom.plans import adapters as a
from graphloom.sources import files
from graphloom.sources.tables import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def seed_match(spark, sf):
    """The flagship."""
    t, r = a.halves(spark, sf)
    return similarity.string_seeds(t, r).select("t_id", "r_id", "confidence", "technique")


@query
def seed_acceptances(spark, sf):
    """W2."""
    return similarity.seed_acceptances(*a.halves(spark, sf))


@query
def seed_transfer(spark, sf):
    """G4."""
    t, r = a.halves(spark, sf)
    named = match.transfer(t, r, similarity.string_seeds(t, r))
    return named.select("id", "semantic_name", F.round("semantic_confidence", 9).alias("semantic_confidence"), "semantic_source", "source_file")


@query
def string_inventory(spark, sf):
    """P20, S6."""
    return a.module_docs(spark, sf).select("id", F.size("strings").cast("long").alias("n_strings"), F.array_join(F.slice("strings", 1, 3), "|").alias("first_strings"), F.size(F.slice("strings", 1, features.CAP)).cast("long").alias("n_kept"))


@query
def kind_profile(spark, sf):
    """A1, A2, S5."""
    return profile.category_profile(a.module_docs(spark, sf), "wrapKind", "bytes", ["source"])


@query
def graph_stats(spark, sf):
    """A6, A7."""
    return ops.graph_stats(a.module_docs(spark, sf), ["source"])


@query
def largest_modules(spark, sf):
    """S1."""
    return a.module_docs(spark, sf).select("id", "ord", "bytes").orderBy(F.desc("bytes"), "ord").limit(15)


@query
def largest_per_source(spark, sf):
    """S3."""
    return ops.pick_per_group(a.module_docs(spark, sf).select("source", "id", "ord", "bytes"), ["source"], [F.desc("bytes"), F.col("ord")], 5).withColumn("rank", F.col("rank").cast("long"))


@query
def string_search(spark, sf):
    """P31."""
    return ops.with_string(a.module_docs(spark, sf), "(?i)th.*nd|que l|der ").select("id")


@query
def string_samples(spark, sf):
    """P30."""
    return a.module_docs(spark, sf).select("id", F.array_join(ops.sample_strings(6), "|").alias("sample"))


@query
def edge_degrees(spark, sf):
    """A13."""
    return graph.degrees(a.part_edges(spark, sf)).select("id", "fan_out", "fan_in")


@query
def edge_hubs(spark, sf):
    """S2, S4."""
    return graph.hubs(a.part_edges(spark, sf)).select("id", "fan_in", F.col("rank").cast("long").alias("rank"))


@query
def bounded_closure(spark, sf):
    """What each customer reaches in three steps."""
    edges = a.customer_edges(spark, sf)
    return graph.closure(edges, edges.select("bkg_id", F.col("src").alias("start")).distinct(), max_depth=3).select("start", "id", "depth")


@query
def propagate_two_rounds(spark, sf):
    """G5, synchronous."""
    c = a.table(spark, sf, "customer").select(F.lit("g").alias("bkg_id"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("semantic_name"), F.lit(None).cast("double").alias("semantic_confidence"), F.lit(None).cast("string").alias("semantic_source"), F.array("c_name").alias("strings"))
    out = graph.propagate_rounds(c, a.customer_edges(spark, sf), rounds=2)
    return out.select("id", "semantic_name", F.round("semantic_confidence", 9).alias("semantic_confidence"), "semantic_source")


@query
def propagate_in_order(spark, sf):
    """G5, sequential (no SQL form: names given in a pass count at once); blocks of 500 customers are the graphs."""
    c = a.table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 500).alias("bkg_id"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("semantic_name"), F.lit(None).cast("double").alias("semantic_confidence"), F.lit(None).cast("string").alias("semantic_source"), F.array("c_name").alias("strings"))
    w = Window.partitionBy("bkg_id").orderBy("ord")
    near = c.withColumn("deps_out", F.array_compact(F.array(F.lead("id").over(w)))).withColumn("deps_in", F.array_compact(F.array(F.lag("id").over(w))))
    return graph.propagate(near).select("bkg_id", "id", "semantic_name", "semantic_confidence")


@query
def merge_graphs(spark, sf):
    """J9, A9, X1, G9."""
    m = ops.merge_modules(*a.versions(spark, sf))
    return m.select("id", "semantic_name", "semantic_confidence", "source_file", "bytes", F.size("strings").cast("long").alias("n_strings"), "conflict")


@query
def merge_identifiers(spark, sf):
    """G9."""
    x = a.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("semantic"), ((F.col("doc_id") % 7) / 7.0).alias("confidence"))
    y = a.table(spark, sf, "documents").select((F.col("doc_id") + 5).alias("id"), F.col("source").alias("semantic"), ((F.col("doc_id") % 5) / 5.0).alias("confidence"))
    return ops.merge_identifiers(x, y)


@query
def diff_graphs(spark, sf):
    """J10, G10, X3."""
    return ops.diff(*a.versions(spark, sf))


@query
def diff_counts(spark, sf):
    """G10."""
    return ops.diff_summary(ops.diff(*a.versions(spark, sf)))


@query
def evolve_new(spark, sf):
    """A10, G8."""
    return ops.evolve(a.module_docs(spark, sf).drop("text"), "source", 2).select("source", "id", "bytes", F.col("rank").cast("long").alias("rank"))


@query
def evolve_report(spark, sf):
    """G8."""
    m = a.module_docs(spark, sf).drop("text")
    return ops.evolve_report(m, ops.evolve(m, "source", 2), "source").select("source", "unmatched_raw", "real_new", "noise_filtered", F.array_join(F.transform(F.map_entries("new_by_wrap_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("kinds"))


@query
def pair_votes(spark, sf):
    """A12, G13."""
    li = a.table(spark, sf, "lineitem")
    raw = li.select(F.concat(F.lit("p"), (F.col("l_partkey") % 500).cast("string")).alias("minified"), F.concat(F.lit("s"), F.least(F.col("l_suppkey") % 7, F.lit(1)).cast("string")).alias("semantic"))
    return align.vote(raw, []).withColumn("confidence", F.round("confidence", 9))


@query
def rename_claims(spark, sf):
    """W10."""
    first = F.element_at(F.split("text", " "), 1)
    p = a.table(spark, sf, "documents").select(F.lit("b").alias("bkg_id"), F.col("source").alias("module"), (F.col("doc_id") % 20).alias("module_ord"), F.col("doc_id").alias("ord"), first.alias("semantic"))
    taken = a.table(spark, sf, "benchmark").select(F.lit("b").alias("bkg_id"), first.alias("name"))
    return rename.claims(p, taken, ["bkg_id"]).select("module", "module_ord", "ord", "semantic")


@query
def first_pairs(spark, sf):
    """A18, A19."""
    p = a.table(spark, sf, "orders").select(F.lit("b").alias("bkg_id"), F.col("o_custkey").alias("module"), F.col("o_orderpriority").alias("minified"), F.col("o_orderstatus").alias("semantic"), F.col("o_orderkey").alias("ord"))
    return rename.first_pairs(p, ["bkg_id"]).select("module", "minified", "semantic", "ord")


@query
def offset_ranges(spark, sf):
    """J11."""
    return sourcemap.range_join(a.event_offsets(spark, sf), a.document_ranges(spark, sf), ["k"]).select("event_id", "range_id")


@query
def range_mode(spark, sf):
    """A11."""
    placed = sourcemap.range_join(a.event_offsets(spark, sf), a.document_ranges(spark, sf), ["k"]).join(a.table(spark, sf, "events").select("event_id", F.col("event_type").alias("source")), "event_id")
    return sourcemap.source_votes(placed.withColumn("ord", F.col("event_id")), ["range_id"])


@query
def line_offsets(spark, sf):
    """W9."""
    return sourcemap.line_offsets(a.table(spark, sf, "documents").select(F.col("doc_id").alias("map_id"), F.col("text").alias("code"))).select("map_id", F.col("gen_line").cast("long").alias("gen_line"), "line_start")


@query
def vlq_decode(spark, sf):
    """Digests, respelled without continuation digits, read as mappings."""
    digest = F.translate(F.md5("text"), "0123456789", "ABCDEFGHIJ")
    maps = a.table(spark, sf, "documents").select(F.col("doc_id").alias("map_id"), F.regexp_replace(digest, "(.{5})(.{5})", "$1,$2;").alias("mappings"))
    return sourcemap.decode(maps).select("map_id", F.col("gen_line").cast("long").alias("gen_line"), F.col("seg").cast("long").alias("seg"), "gen_col", "source_idx", "source_line", "source_col", "name_idx")


@query
def identifier_at(spark, sf):
    """P32."""
    return a.table(spark, sf, "documents").select("doc_id", sourcemap.identifier_at(F.col("text"), (F.col("doc_id") % 50).cast("int")).alias("name"))


@query
def url_names(spark, sf):
    """Name from a path (scalar family)."""
    return a.table(spark, sf, "pages").select("page_id", sourcemap.base_name(F.regexp_replace("url", r"[?#].*$", "")).alias("name"))


@query
def definitions(spark, sf):
    """P12."""
    return boundary.definitions(a.turn_statements(spark, sf)).select("bundle_id", "name", F.col("ord").cast("long").alias("ord"))


@query
def statement_edges(spark, sf):
    """J1, D4, G1."""
    return boundary.statement_edges(a.turn_statements(spark, sf)).select("bundle_id", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query
def module_edges(spark, sf):
    """J2, S8."""
    s = a.turn_statements(spark, sf)
    assigned = s.select("bundle_id", "ord", F.floor(F.col("ord") / 2).alias("module_id"))
    return boundary.module_edges(boundary.statement_edges(s), assigned).select("bundle_id", "src", "dst")


@query
def free_runs(spark, sf):
    """Runs of turns without a kind."""
    return boundary.free_runs(a.turn_statements(spark, sf), F.col("kind") == "None")


@query
def backtrace(spark, sf):
    """Where each turn is anchored."""
    s = a.turn_statements(spark, sf)
    first = F.min(F.when(F.col("kind") != "None", F.col("ord"))).over(Window.partitionBy("bundle_id"))
    s = s.withColumn("kind", F.when((F.col("kind") == "None") & (first.isNull() | (F.col("ord") < first)), "RUNTIME").otherwise(F.col("kind")))
    empty = F.array().cast("array<struct<callee:string>>")
    out = boundary.anchored(s.select("bundle_id", "ord", "kind", "names", "refs", empty.alias("declarators"), F.element_at("refs", -1).alias("callee")))
    return out.select("bundle_id", F.col("ord").cast("long").alias("ord"), "kind", F.col("module").cast("long").alias("module"))


@query
def sequential_clusters(spark, sf):
    """W4, W5 (state restarts at each split: no SQL form)."""
    s = a.turn_statements(spark, sf)
    uses = boundary.statement_edges(s).groupBy("bundle_id", F.col("src").alias("ord")).agg(F.sort_array(F.collect_set("dst")).alias("uses"))
    rows = s.join(uses, ["bundle_id", "ord"], "left").withColumn("module", F.when(F.col("kind") != "None", F.col("ord")))
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        facts = [(int(o), k, None if pd.isna(m) else int(m), [int(x) for x in u] if u is not None else []) for o, k, m, u in zip(pdf["ord"], pdf["kind"], pdf["module"], pdf["uses"], strict=True)]
        return pd.DataFrame([(pdf["bundle_id"].iloc[0], o, c, k) for o, (c, k) in boundary.fold_runs(facts).items()], columns=["bundle_id", "ord", "cluster", "kind"])

    return rows.select("bundle_id", "ord", "kind", "module", "uses").groupBy("bundle_id").applyInPandas(run, "bundle_id long, ord int, cluster int, kind string")


@query
def module_rollup(spark, sf):
    """A3, P23."""
    s = a.turn_statements(spark, sf).withColumn("inner", F.lit(0)).withColumn("line_start", F.col("ord") * 2).withColumn("line_end", F.col("ord") * 2 + 1).withColumn("start", F.col("ord")).withColumn("end", F.col("ord") + 1).drop("kind")
    out = boundary.module_rollup(s, s.select("bundle_id", "ord", F.floor(F.col("ord") / 3).alias("module_id"), F.lit("CJS").alias("kind")))
    return out.select("bundle_id", "module_id", F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"), "bytes", "stmt_count", "first_name")


@query
def structure_scores(spark, sf):
    """J6."""
    t, r = a.halves(spark, sf)
    best = similarity.gate(similarity.top_two(similarity.structure_scores(t, r)), 0.10, 1.3)
    return best.select("t_id", "r_id", F.round("score", 9).alias("score"))


@query
def fingerprint_match(spark, sf):
    """Fingerprints of targets beside a seed."""
    t, r = a.halves(spark, sf)
    seeds = settled(similarity.string_seeds(t, r), "seeds")  # read several times
    te = t.select("id", F.concat(F.lit("mod:"), (F.col("ord") + 2).cast("string")).alias("near"), F.lit(True).alias("out"))
    return match.fingerprint_round(t, r, te, seeds).select("t_id", "r_id", F.round("confidence", 9).alias("confidence"))


@query
def fingerprint_similarity(spark, sf):
    """G3."""
    m = a.module_docs(spark, sf).select("ord", "id", "ast_fingerprint")
    n = m.select((F.col("ord") - 1).alias("ord"), F.col("ast_fingerprint").alias("other"))
    return m.join(n, "ord").select("id", F.round(similarity.fingerprint_similarity(F.col("ast_fingerprint"), F.col("other")), 9).alias("similarity"))


@query
def neighbour_round(spark, sf):
    """One synchronous round of the second technique; two of three documents are matched beforehand."""
    t, r = a.halves(spark, sf)
    seeds = t.where("floor(ord / 2) % 3 <> 0").join(r.select((F.col("ord") - 1).alias("ord"), F.col("id").alias("r_id")), "ord").select(F.col("id").alias("t_id"), "r_id")
    ring = lambda df: df.select("id", F.explode(F.transform(F.array(*(F.col("ord") + k for k in (2, 4, 6))), lambda x: F.concat(F.lit("mod:"), x.cast("string")))).alias("near"), F.lit(True).alias("out"))
    both = lambda df: df.union(df.select(F.col("near").alias("id"), F.col("id").alias("near"), F.lit(False).alias("out")))
    te, re = both(ring(t)), both(ring(r))
    return match.neighbour_round(t, r, te.where("out or not out"), re, seeds).select("t_id", "r_id", F.round("confidence", 9).alias("confidence"))


def _linked(m: DataFrame) -> DataFrame:
    name = lambda k: F.concat(F.lit("mod:"), (F.col("ord") + k).cast("string"))
    return m.withColumn("deps_out", F.array(name(2), name(4))).withColumn("deps_in", F.array(name(-2), name(-4)))


@query
def match_cascade(spark, sf):
    """G2, synchronous (up to 20 rounds: no SQL form)."""
    t, r = a.halves(spark, sf)
    return match.cascade(_linked(t), _linked(r)).select("t_id", "r_id", "confidence", "technique")


@query
def match_in_order(spark, sf):
    """G2, sequential (no SQL form): blocks of 400 documents are the graphs, so no task grows with the table."""
    t, r = (_linked(x).withColumn("pair", F.floor(F.col("ord") / 400)) for x in a.halves(spark, sf))
    return match.cascade_exact(t, r)


@query
def version_chain(spark, sf):
    """Three versions of blocks of 600 documents, one link after the other (no SQL form)."""
    m = _linked(a.module_docs(spark, sf).drop("text")).withColumn("bkg_id", F.concat(F.lit("v"), (F.col("ord") % 3).cast("string"))).withColumn("block", F.floor(F.col("ord") / 600))
    return chain.chain(m, ["v0", "v1", "v2"], "block")[1]


@query
def set_operations(spark, sf):
    """Strings of neighbouring modules."""
    m = a.module_docs(spark, sf).select("ord", "id", "strings")
    j = m.join(m.select((F.col("ord") - 1).alias("ord"), F.col("strings").alias("other")), "ord")
    n = lambda c: F.size(c).cast("long")
    return j.select("id", n(F.array_union("strings", "other")).alias("n_union"), n(F.array_intersect("strings", "other")).alias("n_both"), n(F.array_except("strings", "other")).alias("n_only"), n(F.slice(F.array_distinct(F.concat("strings", "other")), 1, 50)).alias("n_kept"))


@query
def statement_comments(spark, sf):
    """P8."""
    m = a.module_docs(spark, sf).select((F.col("ord") * 101).alias("ord"), F.concat(F.lit("VAR_DECL."), "wrapKind").alias("category"), F.col("wrapKind").alias("wrap_kind"), F.col("id").alias("name"), (F.col("ord")).alias("line_start"), (F.col("ord") + 1).alias("line_end"), "bytes")
    return m.select("name", profile.header_comment(m).alias("comment"))


@query
def name_headers(spark, sf):
    """P25, J12."""
    m = a.versions(spark, sf)[0].withColumn("deps_in", F.array("id")).withColumn("bkg_id", F.lit("b"))
    return report.name_header(m).select("id", F.md5("header").alias("header_md5"), F.length("header").cast("long").alias("header_length"))


@query
def doc_headers(spark, sf):
    """P26, J14."""
    m = a.versions(spark, sf)[0].withColumn("deps_in", F.array("id")).withColumn("bkg_id", F.lit("b"))
    return report.doc_header(m).select("id", F.md5("header").alias("header_md5"))


@query
def find_modules(spark, sf):
    """J12, J13."""
    m = a.module_docs(spark, sf).withColumn("bkg_id", F.lit("b")).withColumn("id", F.concat(F.lit("mod:"), (F.col("ord") * 67).cast("string")))
    f = a.table(spark, sf, "documents").select(F.lit("b").alias("bkg_id"), F.concat(F.lit("mod_"), text.numbered(F.col("doc_id") * 134), F.lit("_m"), (F.col("doc_id") * 3).cast("string"), F.lit(".js")).alias("filename"))
    return report.find_module(f, m).select("filename", "id")


@query
def reassembled(spark, sf):
    """P27."""
    f = a.table(spark, sf, "documents").select(F.col("source").alias("bkg_id"), F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("filename"), "text")
    return report.reassemble(f).select("bkg_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("length"))


@query
def file_names(spark, sf):
    """IO6, IO13, IO14, P17."""
    p = a.table(spark, sf, "part").select("p_partkey", F.concat(F.lit("mod_"), text.numbered(F.col("p_partkey") * 37), F.lit("_"), "p_name", F.lit(".js")).alias("file"), F.concat(F.lit("02_traced-"), "p_name").alias("stage"))
    return p.select("p_partkey", files.split_name(F.col("file")).alias("name"), files.bare_stage(F.col("stage")).alias("bare"), files.file_hash(F.col("file").cast("binary")).alias("sha256"))


@query
def runs_next(spark, sf):
    """IO11, W11."""
    e = a.table(spark, sf, "orders").select(files.run_number(F.concat(F.lit("/out/RUN_"), F.lpad((F.col("o_orderkey") % 120).cast("string"), 3, "0"), F.lit("/x"))).alias("run"), "o_orderstatus")
    return files.next_runs(e, ("o_orderstatus",))


@query
def event_props(spark, sf):
    """JSON scalar family."""
    return a.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query
def ground_truth(spark, sf):
    """J15, P35."""
    d = a.table(spark, sf, "documents").select(F.lit("b").alias("module"), F.col("doc_id").cast("string").alias("minified"), F.when(F.length("text") > 800, "1").otherwise("0").alias("semantic"))
    truth = a.table(spark, sf, "labels").select(F.lit("b").alias("module"), F.col("doc_id").cast("string").alias("minified"), F.col("quality").cast("string").alias("semantic"))
    return infer.against_truth(d, truth, ["module"]).select("minified", "semantic")


@query
def module_counts(spark, sf):
    """Documents by source and number as sixty targets."""
    name = F.concat("source", F.lit("-"), (F.col("doc_id") % 60).cast("string"))
    d = a.table(spark, sf, "documents").withColumn("name", name).withColumn("k", F.col("doc_id") % 60)
    traced = d.where("k % 10 <> 1").groupBy("name").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lang") == "de").alias("runtime"), F.count_if(F.col("lang") == "es").alias("imports"))
    maps = d.where("lang in ('en', 'fr')").groupBy("name", "k").agg(F.count(F.lit(1)).alias("n")).where("k % 7 <> 0").select("name", (F.col("n") + F.col("k") % 4 - 1).alias("n_sources"))
    targets = d.select("name", "k").distinct().select("name", (F.col("k") % 11 != 0).alias("has_config"), (F.col("k") % 12 != 1).alias("has_bundle"))
    return chain.module_count_check(traced, maps, d.where("k % 6 = 2").select("name", F.lit("known").alias("known_limitation")).distinct(), targets)


@query
def count_status(spark, sf):
    """A15."""
    return chain.status_histogram(module_counts(spark, sf))


@query
def identifier_coverage(spark, sf):
    """A7."""
    d = a.table(spark, sf, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, "semantic").when(F.col("doc_id") % 3 == 1, "placeholder").otherwise("raw").alias("state"))
    return ops.identifier_coverage(d, ["source"])


@query
def positional_zip(spark, sf):
    """Words of neighbouring documents by place."""
    d = a.table(spark, sf, "documents")
    both = d.select("doc_id", F.col("text").alias("minified")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("semantic")), "doc_id")
    return align.name_quality(align.zipped_words(both, ["doc_id"]), ["doc_id"])


def _flagged(doc_id, text):
    """Texts with what the score looks for before some of them, and what it must not count before others."""
    k = doc_id % 5
    return F.concat(F.when(k == 0, "// @bun @bun-cjs\n(function(exports, require, module) {function  a(){} var\tx; require('y')\n").when(k == 1, F.repeat(F.lit("-"), 201)).otherwise(""), F.when(k < 2, "@bytecode function\tf function( var, var\ng require (").otherwise(""), text)


@query
def payload_scores(spark, sf):
    """U4, A16."""
    t = _flagged(F.col("doc_id"), F.col("text"))
    return a.table(spark, sf, "documents").select("doc_id", F.round(unpack.signals(t, F.octet_length(t).cast("long")), 6).alias("score"))


@query
def best_payload(spark, sf):
    """U5, S7."""
    f = a.table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("payload_ix"), _flagged(F.col("doc_id"), F.col("text")).alias("text"))
    f = f.withColumn("size", F.octet_length("text").cast("long"))
    return unpack.choose(f).select("path", "payload_ix", F.round("score", 6).alias("score"))


@query
def unwrapped(spark, sf):
    """P29."""
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("// c\n(function (exports, require, module, __filename, __dirname) {"), "text", F.lit("})"))).otherwise(F.concat(F.lit("(function (exports) {"), "text", F.lit("})")))
    return a.table(spark, sf, "documents").select("doc_id", F.md5(unpack.unwrap(t)).alias("body_md5"))


@query
def carved_payloads(spark, sf):
    """Documents strung together as blobs."""
    d = a.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("\0head // @bun\n").cast("binary"), F.col("text").cast("binary"), F.lit("\n\0\0\0\0\0\0\0\0tail").cast("binary")).alias("content"))
    return unpack.payloads(d).select("path", "payload_ix", F.octet_length("text").cast("long").alias("length"))


@query
def script_statements(spark, sf):
    """Bundles made of conversations, parsed."""
    c = profile.classify(profile.statements_of(a.turn_bundles(spark, sf)))
    return c.select("bundle_id", F.col("ord").cast("long").alias("ord"), "category", "wrap_kind", "name", F.col("bytes").cast("long").alias("bytes"))


@query
def script_bundlers(spark, sf):
    """P3, P4, P24."""
    b = a.turn_bundles(spark, sf)
    return profile.bundle_type(b, profile.statements_of(b)).select("bundle_id", "bundler", "confidence")


@query
def script_bytes(spark, sf):
    """P10."""
    b = a.turn_bundles(spark, sf)
    return profile.byte_accounting(b, profile.statements_of(b)).select("bundle_id", "statement_bytes", "gap_bytes", "total", "balanced")


@query
def script_graph(spark, sf):
    """Scripts to graph modules."""
    g = features.bundle_graph(a.turn_bundles(spark, sf))
    return g.select("bkg_id", "id", "wrapKind", F.col("stmtCount").cast("long").alias("stmtCount"), F.array_join("strings", "|").alias("strings"), "ast_fingerprint", F.array_join("deps_out", ",").alias("deps_out"))


@query
def beautified_scripts(spark, sf):
    """P1."""
    return profile.beautified(a.page_scripts(spark, sf))


@query
def split_modules(spark, sf):
    """Scripts cut into modules."""
    b = a.turn_bundles(spark, sf)
    stmts = profile.statements_of(b)
    split = features.split_modules(b, boundary.module_rollup(stmts, boundary.assign_modules(stmts)))
    return split.select("bundle_id", "filename", F.col("stmt_count").cast("long").alias("stmt_count"), F.md5("text").alias("text_md5"), "parseable")


@query
def annotated_scripts(spark, sf):
    """P8, P9."""
    b = a.turn_bundles(spark, sf)
    return profile.annotated_text(b, profile.classify(profile.statements_of(b))).select("bundle_id", F.md5("text").alias("text_md5"))


@query
def traced_scripts(spark, sf):
    """A comment where each module begins."""
    b = a.turn_bundles(spark, sf)
    stmts = profile.statements_of(b)
    return boundary.boundary_text(b, stmts, boundary.assign_modules(stmts)).select("bundle_id", F.md5("text").alias("text_md5"))


@query
def split_totals(spark, sf):
    """A5."""
    b = a.turn_bundles(spark, sf)
    stmts = profile.statements_of(b)
    out = features.split_stats(features.split_modules(b, boundary.module_rollup(stmts, boundary.assign_modules(stmts))), b)
    return out.select("bundle_id", "wrapKind", "modules", F.col("bytes").cast("long").alias("bytes"), "parseable", "coverage")


def _declared(spark, sf):
    """Bundles beside the same ones with longer names; one of seven has a declaration more."""
    ref = F.concat(F.replace(F.replace(F.col("code"), F.lit("var m"), F.lit("var mod_")), F.lit("function f"), F.lit("function fun_")), F.when(F.col("bundle_id") % 7 == 0, "\nvar extra=1;").otherwise(""))
    return a.turn_bundles(spark, sf).select(F.col("bundle_id").alias("pair"), F.col("code").alias("target_code"), ref.alias("ref_code"))


@query
def aligned_declarations(spark, sf):
    """J17, G14."""
    return align.align_declarations(_declared(spark, sf)).where("minified <> semantic").select("pair", "minified", "semantic")


@query
def aligned_scopes(spark, sf):
    """One name is reserved."""
    return align.align_scopes(_declared(spark, sf), spark.createDataFrame([("m2",)], "name string")).select("pair", "minified", "semantic")


@query
def declaration_counts(spark, sf):
    """A14."""
    return align.declaration_quality(_declared(spark, sf)).select("pair", F.col("t").cast("long").alias("t"), F.col("r").cast("long").alias("r"), "status")


@query
def names_in_use(spark, sf):
    """X5."""
    m = a.turn_bundles(spark, sf).select("bundle_id", F.col("code").alias("text"))
    return rename.names_in_use(m, ["bundle_id"]).where("length(name) >= 2 and name rlike '[0-9]'").select("bundle_id", "name")


def _mapped(spark, sf):
    """Documents as bundles of two modules with source maps: ``(modules, maps, bundles)``."""
    d = a.table(spark, sf, "documents").withColumn("bkg_id", F.col("doc_id").cast("string"))
    text_ = F.to_json(F.struct(F.array(F.concat(F.lit("src/"), "lang", F.lit(".ts")), F.concat(F.lit("lib/"), "source", F.lit(".js"))).alias("sources"), F.array(F.lit("firstName"), F.lit("otherName")).alias("names"), F.lit("AAAAA,gBCAAC").alias("mappings")))
    maps = files.parse_source_maps(d.select("bkg_id", text_.alias("json")), "json").select("bkg_id", "map.sources", "map.names", "map.mappings")
    given = F.col("doc_id") % 3 == 0
    spans = F.explode(F.array(F.struct(F.lit("mod:a").alias("id"), F.lit(0).alias("x"), F.lit(16).alias("y")), F.struct(F.lit("mod:b").alias("id"), F.lit(16).alias("x"), F.length("text").alias("y"))))
    m = d.select("bkg_id", spans.alias("s"), F.when(given, "given").alias("semantic_name"), F.when(given, F.lit(0.7)).alias("semantic_confidence"), F.when(given, F.when(F.col("doc_id") % 2 == 0, "propagation").otherwise("manual")).alias("semantic_source"), F.lit(None).cast("string").alias("source_file"))
    m = m.select("bkg_id", "s.id", "semantic_name", "semantic_confidence", "semantic_source", "source_file", F.struct(F.lit(0).alias("startLine"), F.lit(0).alias("endLine"), F.col("s.x").alias("charStart"), F.col("s.y").alias("charEnd")).alias("range"))
    return m, maps, d.select("bkg_id", F.col("text").alias("code"))


@query
def source_map_modules(spark, sf):
    """IO8, G11."""
    return sourcemap.enrich(*_mapped(spark, sf))[0].select("bkg_id", "id", "semantic_name", "semantic_confidence", "semantic_source", "source_file")


@query
def source_map_identifiers(spark, sf):
    """G11, P32."""
    return sourcemap.enrich(*_mapped(spark, sf))[1].select("bkg_id", "id", "minified", "semantic", "state", "source")


@query
def script_renames(spark, sf):
    """R1, R2, R3, R4."""
    m = a.turn_bundles(spark, sf).select(F.lit("b").alias("bkg_id"), F.col("bundle_id").cast("string").alias("module"), F.col("code").alias("text"))
    turns = a.table(spark, sf, "conversations").where("role = 'user'")
    name = F.when(F.col("conv_id") % 5 == 0, "class").otherwise(F.concat(F.lit("renamed_"), F.col("turn").cast("string")))  # no name: these texts are put back
    pairs = turns.select(F.lit("b").alias("bkg_id"), F.col("conv_id").cast("string").alias("module"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("minified"), name.alias("semantic"))
    return rename.apply_renames(m, pairs, ["bkg_id"]).select("module", F.md5("renamed").alias("renamed_md5"), F.col("replaced").cast("long").alias("replaced"), "reverted")


def naming_client(prompt: str) -> str:
    """Answers with a name for the first short name of a prompt, and with a pair that is not plausible."""
    first = prompt.split("Short names: ", 1)[1].split("\n", 1)[0].split(", ")[0]
    return f'Here it is:\n```json\n[{{"minified": "{first}", "semantic": "named_{first}"}}, {{"minified": "{first}", "semantic": "x"}}]\n```'


@query
def inferred_names(spark, sf):
    """L1, IO15, F-prompt, F-pred: a client that answers from the prompt."""
    return infer.infer(a.turn_bundles(spark, sf).select(F.col("bundle_id").cast("string").alias("module"), "code"), naming_client)


@query
def edge_totals(spark, sf):
    """A20."""
    s = a.turn_statements(spark, sf)
    return graph.totals(boundary.statement_edges(s), boundary.definitions(s), "bundle_id")


@query
def kinds_by_count(spark, sf):
    """S5."""
    return profile.by_count(a.module_docs(spark, sf), "wrapKind", ["source"]).select("source", "wrapKind", "n", F.col("rank").cast("long").alias("rank"))


@query
def full_closure(spark, sf):
    """All that each customer reaches."""
    edges = a.customer_edges(spark, sf)
    return graph.closure(edges, edges.select("bkg_id", F.col("src").alias("start")).distinct()).select("start", "id")


@query
def merged_documents(spark, sf):
    """Whole documents of 20 modules."""
    m = ops.merge_documents(*a.graph_documents(spark, sf))
    size = lambda c: F.size(c).cast("long")
    ids = F.array_join(F.transform("identifiers", lambda i: F.concat(i["id"], F.lit("="), i["state"])), ",")
    return m.select("bkg_id", F.array_join(F.transform("modules", lambda x: x["id"]), ",").alias("ids"), F.col("coverage.modules_named").cast("long").alias("named"), ids.alias("identifiers"), F.col("coverage.identifiers_semantic").cast("long").alias("semantic"), size("annotations").alias("n_annotations"), F.array_join(F.transform("enrichments", lambda e: e["technique"]), ",").alias("techniques"), F.element_at("enrichments", -1)["provenance"].alias("provenance"))


@query
def graph_errors(spark, sf):
    """IO4: documents that break a rule, some of them two."""
    g = a.graph_documents(spark, sf)[0]
    k = F.substring("bkg_id", 2, 10).cast("long")
    twice = F.transform("modules", lambda m, i: m.withField("id", F.when((k % 3 == 0) & (i == 1), F.lit("")).when((k % 4 == 1) & (i > 13), F.lit("same")).otherwise(m["id"])))
    return schema.errors(g.withColumns({"modules": twice, "bkg_version": F.when(k % 5 == 0, "2.0").when(k % 5 != 1, F.col("bkg_version")), "bundle": F.when(k % 6 != 2, F.col("bundle"))}))


@query
def paired_files(spark, sf):
    """Documents as files, matched to the one of the doubled id."""
    d = a.table(spark, sf, "documents")
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"))
    file = d.select(F.lit("p").alias("pair"), F.concat(F.lit("mod_"), name, F.lit(".js")).alias("filename"), name.alias("name"), "text")
    semantic = F.when(F.col("doc_id") % 3 != 1, F.concat(F.when(F.col("doc_id") % 2 == 0, "near_").otherwise(""), F.lit("m"), (F.col("doc_id") * 2).cast("string")))
    m = d.select(F.lit("p").alias("pair"), name.alias("minified_name"), semantic.alias("semantic_name"))
    return report.paired_files(file, file, m).select("minified_name", "ref_name", F.md5("target_code").alias("target_md5"), F.md5("ref_code").alias("ref_md5"))


@query
def statement_kinds(spark, sf):
    """P11, P13, P14."""
    return boundary.statement_kinds(profile.statements_of(a.turn_bundles(spark, sf))).select("bundle_id", F.col("ord").cast("long").alias("ord"), "kind")


@query
def runtime_names(spark, sf):
    """What the runtime module of a bundle uses."""
    b = a.turn_bundles(spark, sf)
    stmts = profile.statements_of(b)
    split = features.split_modules(b, boundary.module_rollup(stmts, boundary.assign_modules(stmts)))
    return align.runtime_names(split).where("name rlike '^[a-z]*[0-9]+$'")


@query
def run_folders(spark, sf):
    """IO11: inputs inside and outside of runs."""
    o = a.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c"))
    base = F.concat(F.lit("/d"), (F.col("c") % 50).cast("string"))
    inside = F.when(F.col("o_orderkey") % 3 == 0, F.concat(base, F.lit("/RUN_"), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit("/x.js"))).otherwise(F.concat(base, F.lit("/x.js")))
    runs = o.where("c % 50 < 40").select(base.alias("base"), (F.col("o_orderkey") % 97).alias("run"))
    return files.run_folders(o.select("o_orderkey", inside.alias("path")), runs).select("o_orderkey", "folder", F.col("run").cast("long").alias("run"), "existing")


@query
def provenance(spark, sf):
    """IO12, F-date: events as the stages of runs; one of seven is a run of its own."""
    run = F.when(F.col("event_id") % 7 == 0, F.col("event_id")).otherwise(-F.floor(F.col("event_id") / 7) - 1)
    e = a.table(spark, sf, "events").select(run.alias("run"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), F.col("event_id").alias("stage"), F.col("event_type").alias("tool"))
    return files.provenance(e, ["run"])

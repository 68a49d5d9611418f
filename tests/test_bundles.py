import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import align, boundary, chain, features, infer, ops, profile, rename, report, sourcemap, unpack
from graphloom.parse import facts, js
from graphloom.sources import files

BUNDLE = """var y=(a,b)=>()=>(b||a((b={exports:{}}).exports,b),b.exports);
var u=(a,b)=>()=>(a&&(b=a(a=0)),b);var q=Object.create;
var L=function(e){return e.__esModule?e:{default:e}};
var A=y((e,m)=>{var k="hello world";m.exports=k;if(k){k=`tpl ${k} tail`}});
function foo(){return new Map}
var helper=1,init=u(()=>{A();foo()});
var imp=A();
init();
var alone=foo(imp);
function last(x){for(const z of x)last(z)}
"""


@pytest.fixture(scope="module")
def bundles(spark):
    return spark.createDataFrame([("b1", BUNDLE), ("flat", "var a=1;\nfunction f(){return a}"), ("bad", "var = ;"), ("empty", "")], "bundle_id string, code string")


def test_classification(bundles):
    rows = {r["ord"]: r for r in profile.classify(profile.statements_of(bundles)).where("bundle_id = 'b1'").collect()}
    assert [rows[k]["category"] for k in range(7)] == ["RUNTIME_HELPER.__commonJS", "RUNTIME_HELPER.__esm", "RUNTIME_HELPER.preamble", "RUNTIME_HELPER.__toESM", "MODULE_FACTORY.__commonJS", "FUNCTION_DECL", "MODULE_FACTORY.__esm"]
    assert rows[0]["name"] == "y → __commonJS" and rows[4]["name"] == "A (via __commonJS)"
    assert [rows[k]["wrap_kind"] for k in (0, 4, 6, 7)] == ["RUNTIME", "CJS", "ESM", "None"]
    kinds = {r["bundle_id"]: (r["bundler"], r["confidence"]) for r in profile.bundle_type(bundles, profile.statements_of(bundles)).collect()}
    assert kinds == {"b1": ("esbuild", "high"), "flat": ("unknown", "low"), "bad": ("unknown", "low"), "empty": ("unknown", "low")}


def test_text_rebuilds_and_bytes_balance(bundles):
    stmts = profile.statements_of(bundles)
    assert all(r["balanced"] for r in profile.byte_accounting(bundles, stmts).collect())
    text = {r["bundle_id"]: r["text"] for r in profile.annotated_text(bundles, profile.classify(stmts)).collect()}
    import re

    assert {k: re.sub(r"/\* === \[.*?=== \*/\n", "", t) for k, t in text.items()} == {r["bundle_id"]: r["code"] for r in bundles.collect()}


def test_modules(bundles):
    stmts = profile.statements_of(bundles)
    got = {r["ord"]: (r["kind"], r["module_id"]) for r in boundary.assign_modules(stmts).where("bundle_id = 'b1'").collect()}
    assert [got[k][0] for k in range(11)] == ["RUNTIME"] * 4 + ["CJS", "ESM", "ESM", "IMPORT", "IMPORT", "IMPORT", "None"]
    assert got[5][1] == got[6][1] and got[7][1] == got[8][1]
    graph = {r["id"]: r for r in features.bundle_graph(bundles).where("bkg_id = 'b1'").collect()}
    assert graph["mod:A"]["strings"] == [" tail", "hello world", "tpl "]
    assert "mod:A" in graph["mod:foo"]["deps_out"] and graph["mod:A"]["wrapKind"] == "CJS"
    assert graph["mod:foo"]["ast_fingerprint"].split(":")[:3] == ["NEW", "RET", "FD"]
    flat = features.bundle_graph(bundles).where("bkg_id = 'flat'").collect()
    assert [r["wrapKind"] for r in flat] == ["RUNTIME"]  # a flat bundle folds into one module


def test_fold_runs():
    rows = [(0, "CJS", 0, []), (1, "None", None, [0]), (2, "None", None, [0]), (3, "None", None, []), (4, "None", None, []), (5, "IMPORT", None, [0]), (6, "CJS", 6, []), (7, "None", None, [3])]
    assert boundary.fold_runs(rows) == {1: (1, "IMPORT"), 2: (1, "IMPORT"), 3: (1, "IMPORT"), 4: (1, "IMPORT"), 5: (1, "IMPORT"), 7: (7, "None")}
    rows = [(0, "CJS", 0, []), (1, "None", None, [0]), (2, "None", None, []), (3, "None", None, [])]
    assert boundary.fold_runs(rows) == {1: (1, "None"), 2: (2, "None"), 3: (2, "None")}


VLQ = {"A": [0], "C": [1], "D": [-1], "E": [2], "AACA": [0, 0, 1, 0], "F": [-2], "H": [-3], "gB": [16]}


def test_vlq(spark):
    got = spark.createDataFrame([(s,) for s in VLQ], "s string").select("s", sourcemap.vlq(F.col("s")).alias("v")).collect()
    assert {r["s"]: r["v"] for r in got} == VLQ


def test_source_map(spark):
    maps = spark.createDataFrame([("m", ["src/one.ts", "src/two.ts"], ["longName", "other"], "AAAAA,IACC;;CCAA,C,EAAC")], "bkg_id string, sources array<string>, names array<string>, mappings string")
    rows = sorted(tuple(r)[1:] for r in sourcemap.decode(maps, "bkg_id").collect())
    assert rows == [(0, 0, 0, 0, 0, 0, 0), (0, 1, 4, 0, 1, 1, None), (2, 0, 1, 1, 1, 1, None), (2, 2, 4, 1, 1, 2, None)]
    bundles = spark.createDataFrame([("m", "var a\n\nxab cd")], "bkg_id string, code string")
    mods = spark.createDataFrame([("m", "mod:a", None, None, None, None, (0, 0, 0, 6)), ("m", "mod:b", "near_x", 0.3, "propagation", None, (0, 0, 7, 20))], "bkg_id string, id string, semantic_name string, semantic_confidence double, semantic_source string, source_file string, range struct<startLine:int,endLine:int,charStart:int,charEnd:int>")
    new, idents = sourcemap.enrich(mods, maps, bundles)
    assert {r["id"]: (r["semantic_name"], r["semantic_source"]) for r in new.collect()} == {"mod:a": ("one", "source_map_file"), "mod:b": ("two", "source_map_file")}
    assert [(r["id"], r["semantic"]) for r in idents.collect()] == [("var:mod:a:var", "longName")]


def test_range_join(spark):
    points = spark.createDataFrame([(1, o) for o in (0, 5, 9, 10, 99_999, 100_000, 250_000)], "k int, offset long")
    ranges = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 5, 100_000), (1, "c", 100_000, 100_000)], "k int, range_id string, start long, end long")
    got = {r["offset"]: r["range_id"] for r in sourcemap.range_join(points, ranges, ["k"], 64).collect()}
    assert got == {0: "a", 5: "b", 9: "b", 10: "b", 99_999: "b"}


def test_rename(spark):
    mods = spark.createDataFrame([("m1", "var ab = 1; var cd = function(ef){ return ef + ab; }; cd(42); x.ab = {ab: ab};"), ("m2", "var x = 1; var ab = x + 2;"), ("m3", "var ab = 1")], "module string, text string").withColumn("bkg_id", F.lit("b"))
    pairs = spark.createDataFrame([("m1", "ab", "counter"), ("m1", "cd", "addToCounter"), ("m1", "ef", "value"), ("m2", "x", "shouldNotRename"), ("m2", "ab", "shouldRename"), ("m3", "ab", "not valid!")], "module string, minified string, semantic string").withColumn("bkg_id", F.lit("b"))
    got = {r["module"]: r for r in rename.apply_renames(mods, pairs, ["bkg_id"]).collect()}
    assert got["m1"]["renamed"] == "var counter = 1; var addToCounter = function(ef){ return ef + counter; }; addToCounter(42); x.ab = {ab: counter};"
    assert got["m2"]["renamed"] == "var x = 1; var shouldRename = x + 2;"
    assert got["m3"]["renamed"] == "var ab = 1" and got["m3"]["reverted"]
    ordered = pairs.withColumn("module_ord", F.substring("module", 2, 1).cast("int")).withColumn("ord", F.lit(0)).withColumn("semantic", F.when(F.col("minified") == "ab", "same").otherwise(F.col("semantic")))
    won = rename.claims(ordered, spark.createDataFrame([("b", "value")], "bkg_id string, name string"), ["bkg_id"])
    assert sorted((r["module"], r["minified"]) for r in won.collect()) == [("m1", "ab"), ("m1", "cd"), ("m2", "x")]


def test_align_and_votes(spark):
    pairs = spark.createDataFrame([(1, "function a(b,c){var d;{let e}}var f", "function load(url,c){var data;{let item}}var cache"), (2, "var a", "var a,b")], "pair int, target_code string, ref_code string")
    got = {(r["minified"], r["semantic"]) for r in align.align_scopes(pairs).collect()}
    assert got == {("a", "load"), ("f", "cache"), ("b", "url"), ("d", "data"), ("e", "item")}
    odd = spark.createDataFrame([(1, "var a,b;{let c}", "var first,length;{let third}{}"), (2, "var q,z;{let c}", "var first;{let third}"), (3, "var q,z", "var one,two")], "pair int, target_code string, ref_code string")
    found = lambda *args: {(r["pair"], r["minified"], r["semantic"]) for r in align.align_scopes(odd, *args).collect()}
    assert found() == {(2, "c", "third"), (3, "q", "one"), (3, "z", "two")}  # scopes differ in 1, counts in one scope of 2
    assert found(None, 1) == {(1, "a", "first"), (1, "c", "third"), (2, "c", "third"), (3, "q", "one"), (3, "z", "two")}
    assert found(spark.createDataFrame([(3, "z"), (2, "q"), (3, "one")], "pair int, name string")) == {(2, "c", "third")}
    raw = spark.createDataFrame([("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x"), ("b", "y"), ("c", "z")], "minified string, semantic string")
    assert sorted(tuple(r) for r in align.vote(raw, []).collect()) == [("a", "x", 8, 0.8), ("c", "z", 1, 1.0)]
    assert {r["pair"]: r["status"] for r in align.declaration_quality(pairs).collect()} == {1: "exact", 2: "close"}
    assert align.align_declarations(pairs).where("pair = 1").count() == 4


def test_unpack(spark):
    script = b"// @bun\n" + b"var a=function(){};\n" * 200
    blob = b"\x7fELF\0\0" + script + b"\0" * 20 + b"junk" + b"// @bun\nsmall\n" + b"\0/$bunfs/x"
    assert [blob[a:b] for a, b in unpack.carve(blob)] == [script, b"// @bun\nsmall\n"]
    assert unpack.carve(b"nothing") == []
    dense = b"// @bun\n" + b"x = 1;\n" * 9000 + bytes(range(1, 30)) * 8192
    assert unpack.carve(dense)[0][1] < len(dense)
    found = unpack.payloads(spark.createDataFrame([("f", bytearray(blob)), ("none", bytearray(b"x"))], "path string, content binary"))
    assert found.count() == 2 and [r["payload_ix"] for r in unpack.choose(found).collect()] == [0]
    with pytest.raises(ValueError):
        unpack.choose(found, "index", 7)
    wrapped = "// note\n(function (exports, require, module, __filename, __dirname) { var a=1; })\n"
    got = spark.createDataFrame([(wrapped,), ("(function(a){})",)], "t string").select(unpack.unwrap(F.col("t"))).collect()
    assert [r[0] for r in got] == ["// note\n var a=1; ", "(function(a){})"]


def test_files_and_graph_documents(spark, bundles, tmp_path):
    (tmp_path / "a.js").write_text("#!/usr/bin/env node\nvar a=1\n")
    row = files.read_scripts(spark, str(tmp_path / "a.js")).first()
    assert (row["shebang"], row["code"]) == ("#!/usr/bin/env node\n", "var a=1\n")
    assert files.read_binaries(spark, str(tmp_path / "a.js")).first()["hash_sha256"]
    mods = features.bundle_graph(bundles)
    info = bundles.select(F.col("bundle_id").alias("bkg_id"), F.struct(F.lit("f").alias("file"), F.lit("1").alias("version"), F.lit("esbuild").alias("bundler"), F.length("code").alias("size_bytes"), F.lit(0).alias("total_modules"), F.lit(0).alias("total_statements"), F.sha2("code", 256).alias("hash_sha256")).alias("bundle"))
    files.write_graph(schema.to_graph(info, mods).where("bkg_id = 'b1'").drop("bkg_id"), str(tmp_path / "g"))
    back = files.read_graphs(spark, str(tmp_path / "g"))
    assert schema.modules_of(back).count() == mods.where("bkg_id = 'b1'").count()
    assert schema.edges_of(schema.modules_of(back)).count() > 0
    (tmp_path / "bad.json").write_text('{"bkg_version": "2.0", "modules": [{"id": "x"}, {"id": "x"}, {"bytes": 1}]}')
    with pytest.raises(ValueError, match="used twice"):
        files.read_graphs(spark, str(tmp_path / "bad.json"))
    (tmp_path / "chain.json").write_text('{"versions": [{"version": "1", "bundle": "a"}, {"version": "2", "bundle": "b"}]}')
    assert [r["version"] for r in files.read_manifest(spark, str(tmp_path / "chain.json")).orderBy("ord").collect()] == ["1", "2"]
    files.record_run(spark, str(tmp_path / "runs"), 1, "classify", "t", ["a"], ["b"])
    files.record_run(spark, str(tmp_path / "runs"), 2, "trace", "t", ["a"], ["b"])
    assert files.next_run(spark.read.parquet(str(tmp_path / "runs"))) == 3
    assert files.find_artifact(spark, str(tmp_path), r"^a\.") == f"{tmp_path}/a.js"
    names = spark.createDataFrame([("02_traced-x.js", "mod_0042_my_name.js", "/x/RUN_07/a")], "a string, b string, c string").select(files.bare_stage(F.col("a")), files.split_name(F.col("b")), files.run_number(F.col("c"))).first()
    assert tuple(names) == ("x.js", "my_name", 7)


def test_reports(spark, bundles):
    mods = features.bundle_graph(bundles).where("bkg_id = 'b1'")
    assert "used by" in report.name_header(mods).first()["header"]
    assert "@importedBy" in report.doc_header(mods).first()["header"]
    page = report.bundle_map(mods, "b<1>")
    assert page.count("<rect") == mods.count() and "b&lt;1&gt;" in page
    split = spark.createDataFrame([("b", 1, "mod_0001_x.js", "two"), ("b", 0, "mod_0000_A.js", "one")], "bkg_id string, ord int, filename string, text string")
    assert report.reassemble(split, markers=False).first()["text"] == "#!/usr/bin/env node\none\ntwo"
    found = report.find_module(spark.createDataFrame([("b1", "mod_0001_A.js"), ("b1", "mod_0009_none.js")], "bkg_id string, filename string"), mods)
    assert {r["filename"]: r["id"] for r in found.collect()} == {"mod_0001_A.js": "mod:A", "mod_0009_none.js": None}


def test_inference(spark):
    reply = 'Sure:\n```json\n[{"minified": "ab", "semantic": "counter"}, {"minified": "toolong", "semantic": "x"}, 3]\n```'
    assert len(infer.answers(reply)) == 2 and infer.answers("no") == [] and len(infer.answers('[{"a": 1}]')) == 1
    mods = spark.createDataFrame([("m", "var ab = 1", "var counter = 1")], "module string, code string, ref_code string")
    got = infer.infer(mods, lambda p: reply, paired=True)
    assert [(r["minified"], r["semantic"]) for r in got.collect()] == [("ab", "counter")]
    truth = spark.createDataFrame([("m", "ab", "total")], "module string, minified string, semantic string")
    assert infer.against_truth(got, truth, ["module"]).count() == 0 and infer.infer(mods).count() == 0
    both = infer.prompts(spark.createDataFrame([("m", "var ab = longName + if_", "var counter = longName + ab")], "module string, code string, ref_code string"), True).first()["prompt"]
    assert "Short names: if_\n" in both and "Readable names: counter\n" in both
    alone = infer.prompts(spark.createDataFrame([("m", "for (var z of abcd) z(ab)")], "module string, code string"), False).first()["prompt"]
    assert "Short names: z, ab\n" in alone
    assert infer.unreserved(got, spark.createDataFrame([("ab",)], "name string")).count() == 0


def test_module_counts(spark):
    traced = spark.createDataFrame([("a", 5, 1, 0), ("b", 6, 1, 0), ("c", 9, 0, 0), ("d", 9, 0, 0), ("e", 1, 0, 0)], "name string, total int, runtime int, imports int")
    maps = spark.createDataFrame([("a", 4), ("b", 4), ("c", 2), ("d", 2), ("f", 1)], "name string, n_sources int")
    got = {r["name"]: r["status"] for r in chain.module_count_check(traced, maps, spark.createDataFrame([("d", "why")], "name string, known_limitation string")).collect()}
    assert got == {"a": "EXACT", "b": "OFF_BY_ONE", "c": "MISMATCH", "d": "KNOWN_LIMITATION", "e": "NO_MAP", "f": "NO_TRACE"}
    targets = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, False), ("x", True, True)], "name string, has_config boolean, has_bundle boolean")
    limits = spark.createDataFrame([("a", "why"), ("x", "why")], "name string, known_limitation string")
    got = {r["name"]: r["status"] for r in chain.module_count_check(traced, maps, limits, targets).collect()}
    assert got == {"a": "KNOWN_LIMITATION", "b": "SKIP", "c": "NO_BUNDLE", "x": "NO_MAP"}


@pytest.mark.parametrize("code", ["a=b\n++c", "x=/[/]\\/g/.test(y)/2", "`a${b+`c${d}`}e`", "class A extends B{static #p=1;get x(){return this.#p}static{f()}async *g(){yield* h()}}", "({a,b=1}=c)", "import a,{b as c} from 'm';export{c as d};export default class{}", "for(const [k,v] of m)f(k)", "(a,b)=>()=>(b||a((b={exports:{}}).exports,b),b.exports)", "a?.b?.[c]?.(d)", "x = {get a(){return 1},set a(v){},async b(){},*c(){},[d]:1,'e':2,3:4,get:5}", "if(a){}/x/.test(b)", "label:for(;;){break label}", "let x=a?b:c?(d):e;y??=z**2", "for await(const x of y);", "async x=>await x"])
def test_parser_takes(code):
    assert js.parse(code).body


@pytest.mark.parametrize("code", ["var a=", "a b", "if(", "'abc", "{", "`x${", "const {a};", "x=>", "1=2"])
def test_parser_refuses(code):
    assert not js.parses(code)


def test_units_and_names():
    s = facts.statements("var {a:[b,...c],d=1,...e}=x,f='😀';")
    assert s[0]["names"] == ["b", "c", "e", "f"] and s[0]["bytes"] == s[0]["end"] - s[0]["start"] + 1


def test_merge_of_documents_without_lists(spark):
    base = dict.fromkeys(("reference", "identifiers", "annotations", "enrichments", "coverage"))
    one = [{"id": "b", "semantic_name": "x", "semantic_confidence": 0.2}, {"id": "a"}]
    two = [{"id": "c"}, {"id": "b", "semantic_name": "y", "semantic_confidence": 0.4}]
    ids = [{"id": "v2", "confidence": 0.5, "state": "raw"}, {"id": "v1", "confidence": None, "state": "semantic"}]
    kind = f"bkg_id string, {schema.GRAPH}"
    doc = lambda key, modules, **more: base | {"bkg_id": key, "bkg_version": "1.0", "bundle": {"file": "f"}, "modules": modules} | more
    a = spark.createDataFrame([doc("k", one), doc("none", None), doc("left", one)], kind)
    b = spark.createDataFrame([doc("k", two, identifiers=ids, reference={"version": "2"}), doc("none", None), doc("right", one)], kind)
    got = {r["bkg_id"]: r for r in ops.merge_documents(a, b, at=F.lit("now")).collect()}
    assert got.keys() == {"k", "none"}
    assert [(m["id"], m["semantic_name"]) for m in got["k"]["modules"]] == [("b", "y"), ("a", None), ("c", None)]
    assert [i["id"] for i in got["k"]["identifiers"]] == ["v2", "v1"] and got["k"]["reference"]["version"] == "2" and got["k"]["annotations"] == []
    assert [(e["timestamp"], e["technique"], e["modules_enriched"], e["identifiers_enriched"], e["provenance"]) for e in got["k"]["enrichments"]] == [("now", "merge", 3, 2, "merge: 1 conflicts resolved by confidence")]
    assert got["none"]["modules"] == [] and got["none"]["identifiers"] == [] and got["none"]["coverage"]["modules_total"] == 0


def test_texts_are_parsed_and_folded_once(spark):
    bundles = spark.createDataFrame([("b", "var y=(a,b)=>()=>(b||a((b={exports:{}}).exports,b),b.exports);var m=y(()=>{});f(m);")], "bundle_id string, code string")
    stmts = profile.statements_of(bundles)
    for df in (stmts, boundary.assign_modules(stmts)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan  # read from a table


def test_batches_do_not_change_statements(spark):
    rows = [("a", "f();g()"), ("b", None), ("c", "var ("), ("d", ""), ("e", "var x=1,y=2;\nh(x)")]
    bundles = spark.createDataFrame(rows, "bundle_id string, code string").coalesce(1)
    got = [sorted(facts.parsed_statements(bundles, "bundle_id", n).collect()) for n in (1, 2, 256)]
    assert [(x["bundle_id"], x["ord"]) for x in got[0]] == [("a", 0), ("a", 1), ("e", 0), ("e", 1)]
    assert got[0] == got[1] == got[2] and [d["name"] for d in got[0][2]["declarators"]] == ["x", "y"]


def test_batches_do_not_change_payloads(spark):
    blob = b"\0head // @bun one\n" + b"\0" * 8 + b"// @bun two\n\0// @bun"
    rows = [("a", blob), ("b", b""), ("c", b"none"), ("d", b"// @bun \xff\n")]
    binaries = spark.createDataFrame(rows, "path string, content binary").coalesce(1)
    got = [sorted(unpack.payloads(binaries, at_once=n).collect()) for n in (1, 3, 64)]
    assert got[0] == got[1] == got[2] and [x["path"] for x in got[0]].count("a") == 3


def test_words_are_zipped_without_a_row_for_each_in_the_join(spark):
    pairs = spark.createDataFrame([(1, "a b c", "a x"), (2, None, "q"), (3, "", "zz")], "k int, minified string, semantic string")
    assert sorted(map(tuple, align.zipped_words(pairs, ["k"]).collect())) == [(1, "a", "a"), (1, "b", "x"), (3, "", "zz")]
    assert sorted(map(tuple, align.name_quality(align.zipped_words(pairs, ["k"]), ["k"]).collect())) == [(1, 1, 0, 1), (3, 0, 1, 0)]

import pytest

from graphloom.functions.text import utf16_length, utf16_order
from graphloom.operators import profile
from graphloom.sources import files
from graphloom.parse import js
from graphloom.parse.layout import beautify
from graphloom.plans.runner import STAGES, run_stages, syntax_check
from graphloom.streaming.arrivals import arriving_scripts, keep_graphs

CODE = "#!/usr/bin/env node\nvar u=(a,b)=>()=>(a&&(b=a(a=0)),b);var k=u(()=>{switch(x){case 1:{f()}}});function g(x){if(x){return{a:1}}else return;}// end"


@pytest.mark.parametrize("code", [CODE, "a=b\n++c", "x=>{}\n/re/.test(y)", "`a\n ${b}`;class A{m(){}static p=1}", "", "  ", "if(a){}/x/.test(b)", "bad ("])
def test_layout_keeps_meaning(code):
    out = beautify(code)
    assert beautify(out) == out
    if js.parses(code.split("\n", 1)[1] if code.startswith("#!") else code):
        kinds = lambda t: [(n.type, n.get("name")) for n, *_ in js.walk(js.parse(t.split("\n", 1)[1] if t.startswith("#!") else t))]
        assert kinds(out) == kinds(code)
    else:
        assert out == code


def test_layout_column(spark):
    rows = spark.createDataFrame([("a", "var a=1;b()"), ("n", None), ("e", "")], "bundle_id string, code string")
    assert {r["bundle_id"]: (r["text"], r["ratio"]) for r in profile.beautified(rows).collect()} == {"a": ("var a=1;\nb()\n", 1.18), "n": (None, None), "e": ("", None)}


def test_utf16(spark):
    texts = ["", "abc", "\U0001f600", "é\U0001f600x\U0001f601", "\ufffd"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["n"] for r in rows.select("t", utf16_length("t").alias("n")).collect()} == {t: len(t.encode("utf-16-le")) // 2 for t in texts}
    assert [r["t"] for r in rows.orderBy(utf16_order("t")).collect()] == sorted(texts, key=lambda t: t.encode("utf-16-be"))


def test_stages_resume(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.js").write_text(CODE)
    (tmp_path / "in" / "bad.js").write_text("var =")
    out = str(tmp_path / "RUN_01")
    run_stages(spark, str(tmp_path / "in"), out, until="assigned")
    done = run_stages(spark, str(tmp_path / "in"), out)
    assert list(done) == list(STAGES)
    assert {r["stage"] for r in spark.read.parquet(f"{out}/runs").collect()} == set(STAGES) and spark.read.parquet(f"{out}/runs").count() == 5
    assert done["graph"].where("bkg_id = 'a.js'").count() >= 2 and done["graph"].where("bkg_id = 'bad.js'").count() == 0
    assert {r["bundle_id"]: r["ok"] for r in syntax_check(done).collect()} == {"a.js": True, "bad.js": False}
    with pytest.raises(ValueError):
        run_stages(spark, str(tmp_path / "in"), out, until="nothing")


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.js").write_text(CODE)
    for more in ((), ("b.js", "c.js")):
        for name in more:
            (tmp_path / "in" / name).write_text("var q=1")
        query = keep_graphs(arriving_scripts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["batch"], r["bkg_id"]) for r in got.select("batch", "bkg_id").distinct().collect()} == {(0, "a.js"), (1, "b.js"), (1, "c.js")}


def test_runs(spark):
    inputs = spark.createDataFrame([("/a/RUN_03/x.js",), ("/a/x.js",), ("/a/y.js",), ("/b/x.js",), ("/RUN_1/c/x.js",)], "path string")
    runs = spark.createDataFrame([("/a", 3), ("/a", 120), ("/a", 9)], "base string, run int")
    got = {r["path"]: (r["folder"], r["run"], r["existing"]) for r in files.run_folders(inputs, runs).collect()}
    assert got == {"/a/RUN_03/x.js": ("/a/RUN_03", 3, True), "/a/x.js": ("/a/RUN_121", 121, False), "/a/y.js": ("/a/RUN_121", 121, False), "/b/x.js": ("/b/RUN_00", 0, False), "/RUN_1/c/x.js": ("/RUN_1/c/RUN_00", 0, False)}
    assert files.next_run(runs.where("base = 'none'")) == 0
    records = spark.createDataFrame([(1, "t1", "beautify"), (2, "t2", "trace"), (2, "t1", "classify")], "run int, timestamp string, tool string")
    assert {r["run"]: r["document"] for r in files.provenance(records, ["run"]).collect()} == {1: '{"timestamp":"t1","tool":"beautify"}', 2: '{"stages":[{"timestamp":"t1","tool":"classify"},{"timestamp":"t2","tool":"trace"}],"last_updated":"t2"}'}

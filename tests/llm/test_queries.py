"""The registered queries on the smallest tables: columns of each contract, whole results, SQL where there is any."""

import os

import duckdb
import pytest

from graphloom.llm import oracles, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op2_decontaminate": "doc_id bigint, item_id bigint",
    "op3_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op4_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op5_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op7_quality": "doc_id bigint, kept boolean",
    "op8_line_dedup": "doc_id bigint, line_no bigint, keep_doc_id bigint",
    "op9_token_planes": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
}
WHOLE = {"op1_url_filter": "pages"} | dict.fromkeys([q for q in COLUMNS if q not in ("op1_url_filter", "op2_decontaminate", "op8_line_dedup")], "documents")


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    out = queries.queries()[name](spark, SF)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    rows = out.collect()
    assert rows
    if table := WHOLE.get(name):
        key = "page_id" if table == "pages" else "doc_id"
        assert sorted(r[key] for r in rows) == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        path = f"{SF}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    want = con.sql(oracles.oracle_sql()[name])
    columns = sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    out = queries.queries()[name](spark, SF)
    assert sorted(out.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == sorted((tuple(r[k] for k in place) for r in want.fetchall()), key=repr)

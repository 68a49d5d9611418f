"""Every operator on rows of nulls, repeated rows and tables whose other columns have the operators' own names."""

import pytest
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, importance, langid, line_dedup, mixing, recompress, simhash, template_decontam, token_planes, url_graph

NAMES = "id sha len kept keep_id size pattern taken target source_size row fp words key n d1 d2 h pos at line h1 h2 held_out lang_pred score good tmpl plain width bucket item_id weight first starts component_id root quality toxic start data n_words by_rule by_host host_trust kind".split()
TEXT = "one two three four five six seven eight nine ten eleven twelve\nanother line of five words\nanother line of six odd words"
TEXTS = [TEXT, TEXT, TEXT + " x", None, "", "  ", TEXT.replace("five", "5"), "short", " ".join(map(str, range(40)))]
IDS = [1, 1, 2, 3, 4, 5, 6, 7, None]


def planes(d):
    import public_tokenizers

    return token_planes.read_documents(token_planes.write_segments(d, public_tokenizers.path("word_bpe_49k.json")))


def items(d):
    return d.sparkSession.createDataFrame([(1, "one two three four five six seven", "x"), (None, None, None)], "item_id long, text string, doc_id string")


def labels(d):
    return d.sparkSession.createDataFrame([(1, 1, 0, "x"), (6, 0, 1, "x"), (7, None, None, None), (None, 1, None, None)], "doc_id long, quality int, toxic int, text string")


OPERATORS = {
    "exact": (exact_dedup.exact_dedup, ["doc_id", "keep_id", "group_size", "kept"]),
    "substring": (recompress.substring_dedup, ["doc_id", "n_words", "n_removed", "kept"]),
    "mix": (lambda d: mixing.mix(d, F.array("source"), mixing.by_turns), ["doc_id", "size", "taken", "target"]),
    "simhash": (simhash.near_duplicates, ["doc_id", "fp", "component_id"]),
    "one of a group": (simhash.drop_duplicates, ["doc_id", "text"]),
    "language": (langid.identify, ["doc_id", "held_out", "lang_pred", "score"]),
    "quality": (lambda d: importance.select_quality(d, labels(d)), ["doc_id", "log_weight", "kept"]),
    "lines": (line_dedup.dropped_lines, ["doc_id", "line_no", "keep_doc_id", "keep_line_no", "edits"]),
    "texts without lines": (line_dedup.dedup_lines, ["doc_id", "text"]),
    "planes": (planes, ["doc_id", "start", "n_tokens", "ids_crc32"]),
    "leaks": (lambda d: template_decontam.leaks(d, items(d)), ["doc_id", "item_id", "kind"]),
    "clean": (lambda d: template_decontam.decontaminate(d, items(d)), ["doc_id", "text"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_do_not_matter(docs, name):
    run, columns = OPERATORS[name]
    plain = docs(TEXTS, ids=IDS, langs=["en", "en", None, "en", "de", None, "de", "fr", "fr"], sources=["a", "a", None, "b", "b", "c", None, "c", "a"])
    empty = plain.select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in plain.dtypes if c != "doc_id")).where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))
    plain = plain.union(empty)
    odd = plain.withColumns({c: F.lit("x") for c in NAMES if c not in plain.columns})
    key = lambda df: sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
    got = key(run(odd))
    assert got == key(run(plain))
    if name not in ("one of a group", "lines", "leaks", "clean"):
        assert len(got) == len(TEXTS) + 1


def test_pages_with_other_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", '<a href="http://x.com/de/1">'), (1, "http://a.org/x", '<a href="http://x.com/de/1">'), (2, "http://x.com/de/1", '<a href="//b.net/">'), (None, None, None), (3, "http://b.net/", "")], "page_id long, url string, html string")
    odd = pages.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "by_rule", "n", "src", "dst", "kind", "score", "trust")})
    key = lambda df: sorted((tuple(r[c] for c in ("page_id", "host", "rule", "verdict")) for r in df.collect()), key=repr)
    assert key(url_graph.judge(odd)) == key(url_graph.judge(pages)) and len(key(url_graph.judge(odd))) == 5

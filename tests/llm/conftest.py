import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture
def docs(spark):
    """Documents from texts; other columns may be given by name."""

    def make(texts, **more):
        rows = [(more.get("ids", range(len(texts)))[k], t, more.get("langs", ["en"] * len(texts))[k], more.get("sources", ["a"] * len(texts))[k], len(t or ""), "x") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows):
        full = [(*r, None) if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in full], DOCS)

    return make


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

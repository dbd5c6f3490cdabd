import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table with the given (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, **more):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def folder_of(tmp_path):
    """A folder whose tables are the given frames."""

    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/in/{name}.parquet")
        return f"{tmp_path}/in"

    return make

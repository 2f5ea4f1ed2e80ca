import pytest


@pytest.fixture
def table(spark):
    """A documents table from (doc_id, text) pairs, with the other columns and one that clashes with nothing it should."""

    def make(*rows, extra=False):
        full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "'x' AS ids", "1 AS key", "2 AS bucket", "3 AS pos", "4 AS line", "'5' AS _salt", "6 AS n", "7 AS id") if extra else df

    return make

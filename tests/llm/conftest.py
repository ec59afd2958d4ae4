import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from [(doc_id, text)], with a further column whose name clashes with those that operators make."""

    def make(rows, **more):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        return df.withColumns({k: F.lit(v) for k, v in more.items()})

    return make

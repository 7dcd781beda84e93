import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """DataFrame of documents from (doc_id, text) pairs, with the other columns."""

    def make(rows, partitions=3):
        full = [(i, t, None if t is None else "en", "src0", None if t is None else len(t)) for i, t in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.repartition(partitions) if rows else df

    return make

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents of (id, text) pairs, over three partitions, with a column whose name an operator uses itself."""

    def make(rows, extra=True):
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in rows], DOCS + ", score string, kept int")
        frame = frame if extra else frame.drop("score", "kept")
        return frame.repartition(3) if rows else frame

    return make

import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.StringType()), T.StructField("fp", T.LongType())])


@pytest.fixture(scope="session")
def frame(spark):
    """A table of (doc_id, text) with two extra columns whose names clash with internal ones."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOC)

    return make

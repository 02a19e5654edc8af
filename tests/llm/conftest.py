import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])


@pytest.fixture
def docs(spark):
    """Makes a documents table; missing lang and source are filled in."""
    def make(rows):
        return spark.createDataFrame([(*r, *("en", "s")[len(r) - 2:]) if len(r) < 4 else r for r in rows], DOCS)
    return make


@pytest.fixture
def odd_docs(docs):
    """Null ids, null, empty, blank, very long and repeated texts, null lang and source."""
    return docs([(1, None), (2, ""), (3, " \n \t"), (4, "word " * 60_000), (5, "a plain line of text"), (5, "a plain line of text"),
                 (6, "a plain line of text"), (None, "a row without an id"), (7, "ümläut ß ça", None, None)])

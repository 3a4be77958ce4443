import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of (doc_id, text) pairs or of (doc_id, text, lang)."""

    def make(rows):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
        return spark.createDataFrame([(*r, None)[:3] if len(r) == 2 else r for r in rows], schema)

    return make

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def docs_of(spark: SparkSession):
    """Documents with an extra column whose name clashes with working columns."""
    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, n string, token string"
        return spark.createDataFrame(
            [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", "y") for i, t in rows], schema)
    return make

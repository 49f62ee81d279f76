import pytest

from sediment.llm.queries import reach_workers

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def importable(spark):
    reach_workers(spark)


@pytest.fixture
def texts(spark):
    """Documents from (doc_id, text), with a column whose name an operator uses itself."""

    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
        return df.selectExpr("*", "1 as h", "2 as rep", "3 as shard").repartition(parts) if rows else df

    return make

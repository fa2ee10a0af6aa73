import pytest
from pyspark.sql import Row

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, key int, Kept boolean"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents, with columns of clashing names, from (id, text) or (id, text, source)."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1, None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def plain(rows):
    return [r.asDict() if isinstance(r, Row) else r for r in rows]

"""What Python holds of a file doesn't grow with the file, and the pieces make the whole."""

import duckdb
import pytest
from pyspark.sql import functions as F

from declgraph.queries import catalogue, more, tree  # noqa: F401  (they register their queries)
from helpers import DATA, rows_in, rows_of

COPIES, SHIFT = 15, 20_000  #: of each table; keys to 300,000
LINES = {"part": 40, "customer": 30, "supplier": 5}  #: of a module within 100,000 keys, at most: 5 copies of 200, 150 and 10 rows over 25 modules
READ = {
    "tree_arguments": ["argument"],
    "tree_summary": ["preference", "plugin", "virtual", "argument"],
    "tree_area_section": ["preference"],
    "tree_config_section": ["setting"],
    "tree_fieldsets": ["fieldset"],
    "tree_columns": ["table", "column"],
    "tree_catalog_attributes": ["catalogue"],
    "tree_routes": ["route"],
    "tree_webapi": ["webapi"],
}


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("copies"))
    for name, key in (("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", None)):
        rows = spark.read.parquet(f"{DATA}/{name}.parquet")
        if key:
            rows = rows.crossJoin(spark.range(COPIES).withColumnRenamed("id", "__k")).withColumn(key, F.col(key) + SHIFT * F.col("__k")).drop("__k")
        rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", READ)
def test_pieces_stay_small_and_make_the_whole(spark, copies, name):
    """Before, a file was one value, as long as all its declarations."""
    kinds = READ[name]
    own = tree.files(spark, copies, kinds).filter(F.substring_index("path", "/", -1).isin([tree.KINDS[k][0] for k in kinds]))
    longest, lines = own.select((F.size(F.split("content", "\n")) - 2).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert longest <= sum(n for k in kinds for t, n in LINES.items() if f"{{{t}}}" in tree.KINDS[k][3])
    assert lines == sum(tree.declared(spark, copies, k).count() for k in kinds)
    connection = duckdb.connect()
    for t in ("part", "customer", "supplier", "nation"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{copies}/{t}.parquet/*.parquet')")
    rows = rows_of(catalogue.QUERIES[name](spark, copies))
    assert rows and rows == rows_in(connection.sql(catalogue.ORACLES[name]))

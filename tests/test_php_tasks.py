"""Long work on the rows of a small table is many tasks' work."""

from pyspark.sql import functions as F

from declgraph.queries import more
from helpers import DATA


def test_methods_are_read_in_many_tasks(spark):
    """Before, as many as the file has row groups: one."""
    rows = more.php_methods(spark, DATA)
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 4

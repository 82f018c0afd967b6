"""Shuffles start with partitions for the stated size; equal keys without an order are decided alike."""

import pytest
from pyspark.sql import functions as F

from cardwatch.session import initial_partitions
from cardwatch.sources import sinks


@pytest.mark.parametrize(("size", "want"), [(0, 200), (1 << 30, 200), (1 << 40, 8_192), ((1 << 40) + 1, 8_193), (100 << 40, 100_000)])
def test_initial_partitions(size, want):
    assert initial_partitions(size) == want


def test_first_row_without_an_order(spark):
    rows = spark.range(2_000).select((F.col("id") % 50).alias("trans_num"), (F.col("id") * 7919 % 2_003).cast("string").alias("v"))
    found = [
        sorted(map(tuple, sinks.insert_if_absent(rows.repartition(parts, "v"), rows.limit(0)).collect())) for parts in (1, 3, 8)
    ]
    assert len(found[0]) == 50 and found[0] == found[1] == found[2]

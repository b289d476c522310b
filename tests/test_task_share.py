"""A task's share of a table doesn't grow with the table: parts follow the number of rows. F3, F4, F5."""

import pytest
from ordwell import session
from ordwell.plans import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["b8_wide_state", "mu6_deduplicate", "f3_row_split"])
def test_parts_follow_rows(spark, monkeypatch, name):
    few = registry.QUERIES[name](spark, SF)
    rows = sorted(map(str, few.collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 300)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        many = registry.QUERIES[name](spark, SF)
        assert many.groupBy(F.spark_partition_id()).count().count() >= 8  # the session's own number is 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert sorted(map(str, many.collect())) == rows

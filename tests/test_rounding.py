"""Rounding of doubles as the oracle's engine does it."""

import duckdb
from ordwell.plans import registry
from pyspark.sql import functions as F


def test_time_format_at_halves_of_the_last_digit(spark, tmp_path):
    """Times whose fortieth lies at k + half a hundredth (0.095, 0.195, ...), as doubles on either side of it. F1."""
    rows = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 4_000_000 + 3_800_000).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 50).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = dict(con.sql(registry.ORACLES["j1_time_format"]).fetchall())
    got = {r.event_id: r.text for r in registry.QUERIES["j1_time_format"](spark, str(tmp_path)).collect()}
    assert got == want

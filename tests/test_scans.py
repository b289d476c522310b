"""Scans in two levels against windows, with all rows in one key."""

import random

from ordwell.operators import matching, scans
from ordwell.operators import states as s
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_key_many_parts(spark):
    rnd = random.Random(4)
    left = spark.createDataFrame([(rnd.choice([1, 1, 1, 1, 2, None]), rnd.randrange(900), i) for i in range(2000)], "k int, at int, i int").repartition(5)
    right = spark.createDataFrame([(rnd.choice([1, 1, 1, 2]), rnd.randrange(900), rnd.randrange(99)) for _ in range(700)], "k int, at int, v int")
    assert rows(scans.asof_spread(left, right, ["k"], "at", ["v"], 13)) == rows(matching.asof(left, right, ["k"], "at", ["v"]))
    spans = right.select("k", F.col("at").alias("first"), (F.col("at") + F.col("v") % 5).alias("last")).where("first % 3 = 0")
    assert rows(scans.covered_spread(left, spans, ["k"], "at", "c", 13)) == rows(matching.covered(left, spans, ["k"], "at", "c"))
    parts = scans.dealt(left, ["k"], ["at", "i"], 13).groupBy("part", "k").count().collect()
    assert len(parts) >= 13 and max(p["count"] for p in parts) < 2.5 * 2000 / 13


def test_freeze(spark):
    rnd = random.Random(5)
    own = [(m, slot, f, rnd.choice("abc"), rnd.random() < 0.6, rnd.choice([None, 1, 2])) for m, slot, n in ((1, 0, 400), (1, 1, 3), (2, 0, 1)) for f in range(n)]
    df = spark.createDataFrame(own, "match_id long, slot int, frame int, hero string, is_dead boolean, ult_charge int")
    got = scans.freeze_spread(df, ["match_id", "slot"], "frame", "is_dead", ["hero", "ult_charge"], 9)
    assert rows(got) == rows(s.freeze_while_dead(df, "hero", "ult_charge").select(*got.columns))
    assert scans.freeze_spread(df.limit(0), ["match_id", "slot"], "frame", "is_dead", ["hero"], 3).count() == 0

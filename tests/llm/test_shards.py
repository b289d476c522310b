import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from ordwell.llm import shards as s


def draw(name, weight):
    u = (int(hashlib.md5(name.encode()).hexdigest()[: s.DIGITS], 16) + 0.5) / 16**s.DIGITS
    return -math.log(u) / weight


def slow(key, shape):
    total = lambda node: node if isinstance(node, float) else sum(map(total, node.values()))
    node = shape
    for level in ("region", "rack", "shard"):
        won = min((draw(f"{key}/{level}{k}", total(x)), k) for k, x in node.items())[1]
        node = node[won]
    return won


def test_tree():
    assert s.tree(5, racks=2, leaves=2) == {0: {0: {0: 1.0, 1: 1.0}, 1: {2: 1.0, 3: 1.0}}, 1: {2: {4: 1.0}}}


def test_assign(spark):
    rows = [(k, "t" * (k % 7)) for k in range(3000)] + [(None, None), (5, "x"), (5, "ttttt")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, shard int")
    got = s.assign(spark, df, shape=s.tree(16), grown=s.tree(17)).collect()
    assert len(got) == len(rows)
    for r in got[:300]:
        assert r.shard == slow("null" if r.doc_id is None else r.doc_id, s.tree(16))
        assert r.grown_shard == slow("null" if r.doc_id is None else r.doc_id, s.tree(17))
    assert all(r.grown_shard in (r.shard, 16) for r in got) and any(r.grown_shard == 16 for r in got)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.4 * len(rows) / 16
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))


def test_weights_move_only_the_changed_shard(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("region"), F.lit(2).alias("rack"))
    heavy = s.tree(16, {3: 3.0})
    got = s.descend(s.descend(df, F.col("k"), s.tree(16), "a"), F.col("k"), heavy, "b")
    assert got.columns == ["k", "region", "rack", "a", "b"]
    got = got.collect()
    moved = [r for r in got if r.a != r.b]
    # into the region that grew; inside it into the rack, and inside that into the shard that grew
    assert moved and all(r.b < 8 for r in moved)
    assert all(r.b < 4 for r in moved if r.a < 8) and all(r.b == 3 for r in moved if r.a < 4)
    share = sum(r.b == 3 for r in got) / len(got)
    assert abs(share - 3 / 18) < 0.03 and abs(sum(r.a == 3 for r in got) / len(got) - 1 / 16) < 0.02


def test_hot_and_long(spark):
    """A third of all rows without an id, one long text, exact repeats: slots stay gapless."""
    rows = [(None, None)] * 700 + [(7, "x" * 300_000)] * 3 + [(k, "é") for k in range(1400)]
    got = s.assign(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), grown=s.tree(17)).collect()
    by = Counter(r.shard for r in got)
    assert len(got) == len(rows) and all(sorted(r.slot for r in got if r.shard == x) == list(range(n)) for x, n in by.items())
    assert {r.size for r in got} == {1, 3, 300_001} and len({r.shard for r in got if r.doc_id is None}) == 1


def test_empty_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 7), (None, None, 8)], "doc_id long, text string, shard int")
    assert s.assign(spark, df.limit(0)).count() == 0
    s.write_shards(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2

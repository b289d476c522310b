"""Operator 4: sharding by a hierarchical weighted hash tree.

Shards are leaves of a tree of regions, racks and shards. A key descends it: at the
root all regions draw -ln(u) / weight, with u from a hash of key and region, and the
least draw wins; then the racks of that region draw, then the shards of that rack. A
node's weight is that of its subtree, so each child wins in proportion to its weight. A
changed weight changes the draws of that leaf and of its ancestors alone: keys move
into or out of subtrees whose weights changed, and inside such a subtree into or out of
the child that changed; all others stay. A new shard that opens a region of its own, like
the query's, takes keys into itself alone; one in a region that was there draws keys into
that region, and they may land on any shard of it.

Law `key`: the id and the tree decide. Null ids count as the text `null`; rows that
share an id share a shard. Slots number a shard's rows from 0 without gaps, in the order
of the partitions that the placed rows were written from and of the rows in them, so no
id, however often it repeats, makes a group of its own. Null texts have size 1 and the
checksum of the empty text. assign() returns its own columns only, whatever df's others
are called; very long texts are only measured; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordwell.llm.common import fresh, settle, table

SHARDS = 16
RACKS = 2
LEAVES = 4
#: Hex digits of a hash that a draw takes.
DIGITS = 12

Tree = dict[int, dict[int, dict[int, float]]]


def tree(shards: int, weights: dict[int, float] | None = None, racks: int = RACKS, leaves: int = LEAVES) -> Tree:
    """region -> rack -> shard -> weight, filled in order of the shards' numbers."""
    out: Tree = {}
    for s in range(shards):
        w = (weights or {}).get(s, 1.0)
        if w > 0:
            out.setdefault(s // (racks * leaves), {}).setdefault(s // leaves, {})[s] = w
    return out


def unit(text: Column) -> Column:
    """A number strictly between 0 and 1 from the first hex digits of a text's MD5."""
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the least weighted draw; ties go to the smaller number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct((-F.ln(unit(F.concat(key, F.lit(f"/{level}{child}")))) / F.lit(w)).alias("draw"), F.lit(child).alias("child")) for child, w in weights.items()]
    return reduce(F.least, draws)["child"]


def by_node(node: Column, choices: dict[int, Column]) -> Column:
    """The choice of the node won above; only that one's draws are worked out."""
    first, *rest = choices.items()
    return reduce(lambda out, x: out.when(node == x[0], x[1]), rest, F.when(node == first[0], first[1]))


def descend(df: DataFrame, key: Column, shape: Tree, to: str) -> DataFrame:
    """df with the shard of key in column to, by a draw at each level."""
    region, rack = fresh(df.withColumn(to, F.lit(0)), "region", "rack")
    weight = lambda racks: sum(sum(leaves.values()) for leaves in racks.values())
    racks = {r: leaves for own in shape.values() for r, leaves in own.items()}
    out = df.withColumn(region, winner(key, "region", {k: weight(own) for k, own in shape.items()}))
    out = out.withColumn(rack, by_node(F.col(region), {k: winner(key, "rack", {r: sum(leaves.values()) for r, leaves in own.items()}) for k, own in shape.items()}))
    out = out.withColumn(to, by_node(F.col(rack), {r: winner(key, "shard", leaves) for r, leaves in racks.items()}))
    return out.drop(region, rack)


def assign(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", shape: Tree | None = None, grown: Tree | None = None) -> DataFrame:
    """df's ids with size, text_crc32, shard, slot and grown_shard (the shard under tree grown)."""
    shape = shape or tree(SHARDS)
    narrow = df.select(
        F.col(doc_id).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("key"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = descend(narrow, F.col("key"), shape, "shard")
    placed = descend(placed, F.col("key"), grown, "grown_shard") if grown else placed.withColumn("grown_shard", F.lit(None).cast("int"))
    placed = settle(spark, placed.drop("key"))
    counts = placed.groupBy("shard", "part").count()  # as many rows for a shard as partitions were written
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row"))
    slots = placed.withColumn("inside", inside).join(offsets, ["shard", "part"])
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("inside") - 1).cast("long").alias("slot"), "grown_shard")


def write_shards(df: DataFrame, path: str, doc_id: str = "doc_id", shape: Tree | None = None) -> None:
    """Write df as Parquet, a folder for each shard."""
    (shard,) = fresh(df, "shard")
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    descend(df, key, shape or tree(SHARDS), shard).write.partitionBy(shard).parquet(path)


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard after one more is added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = assign(spark, docs, shape=tree(SHARDS), grown=tree(SHARDS + 1))
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op4_shards": op4_shards}
ORACLES: dict[str, str] = {}

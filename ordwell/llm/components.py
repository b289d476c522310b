"""Connected components of a graph that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.common import forget, join_by_weight, settle


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (columns a, b, long): root is the smallest node reachable.

    Large-star and small-star steps in turn, each an aggregation that combines before
    the shuffle and a join in which the neighbours of a hub aren't brought together;
    every step is written to the shared folder. It ends when a round changes nothing:
    then all edges lead to roots.
    """
    now = settle(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = fingerprint(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(spark, both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"))
        large = settle(spark, join_by_weight(both.where("b > a"), least, "a", "n", 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")))
        own = settle(spark, large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_by_weight(large, own, "a", "n", large.count()).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(spark, small.union(own.select("a", F.col("m").alias("b"))).distinct())
        mark, before = fingerprint(after), mark
        forget(spark, now, least, large, own)
        now = after
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksum of a set of edges."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("b", "a"))).first())

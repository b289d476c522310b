"""Ordered and interval joins, by one sort instead of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: str, take: list[str]) -> DataFrame:
    """left with columns take of the last right row of the same keys whose order isn't later.

    Both sides are united and sorted once per key; nothing is paired. Among right rows of
    one order value the greatest take wins.
    """
    held = F.struct(F.col(order).alias("at"), F.struct(*take).alias("take"))
    marked = right.select(*keys, order, held.alias("held_row"), F.lit(0).alias("right_first"))
    both = left.withColumn("right_first", F.lit(1)).unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("found", F.max("held_row").over(w)).where("right_first = 1")
    return out.select(*left.columns, *(F.col(f"found.take.{c}").alias(c) for c in take))


def covered(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, to: str) -> DataFrame:
    """points with a boolean column to: some interval (first, last) of the keys covers at.

    An interval is +1 at its first and -1 after its last; a running sum over points and
    bounds tells how many are open.
    """
    bounds = intervals.select(*keys, F.explode(F.array(F.struct(F.col("first").alias("p"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("p"), F.lit(-1).alias("d")))).alias("b"))
    bounds = bounds.select(*keys, F.col("b.p").alias(at), F.col("b.d").alias("open_change"))
    both = points.withColumn("open_change", F.lit(0)).withColumn("is_point", F.lit(True)).unionByName(bounds, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn(to, F.sum("open_change").over(w) > 0).where("is_point")
    return out.select(*points.columns, to)


def merge_intervals(intervals: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Intervals of each key with those that overlap or touch united."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    reach = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (reach.isNull() | (F.col(first) > reach)).cast("int")
    marked = intervals.withColumn("new_run", new).withColumn("run", F.sum("new_run").over(w))
    return marked.groupBy(*keys, "run").agg(F.min(first).alias(first), F.max(last).alias(last)).drop("run")

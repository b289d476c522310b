"""Running values along a key's rows in two levels, for keys that may hold any share of all rows.

Rows are dealt to parts by ranges of (key, order), so a large key spans many parts, each of
bounded size. Every part scans its own rows; a row for each part and key, its carry, says
what the part hands on; a scan over those carries alone says what each part takes over, and
that corrects the part's rows. The results are those of one window over the key. Rows that
agree in key and order stay in one part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordwell.session import cut


def dealt(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with part, by ranges of keys and order; written once, as the number of a partition holds for one run only."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()))


def carried(df: DataFrame, keys: list[str], carry: Column, taken: Column) -> DataFrame:
    """df (dealt) with taken: taken is an expression over `carry` of the earlier parts of the key, as a window `before`."""
    carries = df.groupBy(*keys, "part").agg(carry.alias("carry"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    given = carries.select(*(F.col(k).alias(f"carry_{k}") for k in keys), F.col("part").alias("carry_part"), taken.over(before).alias("taken"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"carry_{k}")) for k in keys], F.col("part") == F.col("carry_part"))
    return df.join(given, same, "left").drop("carry_part", *(f"carry_{k}" for k in keys))


def inside(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def last_so_far(df: DataFrame, keys: list[str], order: list[str], value: str, to: str, parts: int | None = None) -> DataFrame:
    """df with the last non-null value up to each row of its key. order must be total."""
    rows = dealt(df, keys, order, parts)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    out = carried(rows, keys, last, F.last("carry", ignorenulls=True))
    return out.withColumn(to, F.coalesce(F.last(value, ignorenulls=True).over(inside(keys, order)), F.col("taken"))).drop("part", "taken")


def sum_so_far(df: DataFrame, keys: list[str], order: list[str], value: str, to: str, parts: int | None = None) -> DataFrame:
    """df with the sum of value up to each row of its key. order must be total, or value zero in all but the first of equals."""
    rows = dealt(df, keys, order, parts)
    out = carried(rows, keys, F.sum(value), F.sum("carry"))
    return out.withColumn(to, F.sum(value).over(inside(keys, order)) + F.coalesce(F.col("taken"), F.lit(0))).drop("part", "taken")


def asof_spread(left: DataFrame, right: DataFrame, keys: list[str], order: str, take: list[str], parts: int | None = None) -> DataFrame:
    """matching.asof for keys of any size: left with columns take of the last right row whose order isn't later; of equals the greatest take."""
    marked = right.select(*keys, order, F.struct(*take).alias("held_row"), F.lit(0).alias("right_first"), F.lit(None).cast("long").alias("left_row"))
    both = left.withColumns({"right_first": F.lit(1), "left_row": F.monotonically_increasing_id()}).unionByName(marked, allowMissingColumns=True)
    out = last_so_far(both, keys, [order, "right_first", "held_row", "left_row"], "held_row", "found", parts)
    return out.where("right_first = 1").select(*left.columns, *(F.col(f"found.{c}").alias(c) for c in take))


def covered_spread(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, to: str, parts: int | None = None) -> DataFrame:
    """matching.covered for keys of any size: points with to, whether some interval (first, last) of the keys covers at."""
    ends = F.explode(F.array(F.struct(F.col("first").alias("p"), F.lit(1).alias("d")), F.struct((F.col("last") + 1).alias("p"), F.lit(-1).alias("d"))))
    bounds = intervals.select(*keys, ends.alias("b")).select(*keys, F.col("b.p").alias(at), F.col("b.d").alias("open_change"), F.lit(0).alias("is_point"))
    both = points.withColumns({"open_change": F.lit(0), "is_point": F.lit(1)}).unionByName(bounds, allowMissingColumns=True)
    out = sum_so_far(both, keys, [at, "is_point"], "open_change", "open", parts)
    return out.where("is_point = 1").select(*points.columns, (F.col("open") > 0).alias(to))


def freeze_spread(df: DataFrame, keys: list[str], order: str, dead: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """states.freeze_while_dead for series of any length: columns named *_clean, the value at the last row that isn't dead; before any, at the key's first."""
    held = df.withColumn("alive", F.when(~F.col(dead), F.struct(*columns)))
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order).alias("began")).select(*(F.col(k).alias(f"began_{k}") for k in keys), "began")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"began_{k}")) for k in keys])
    out = last_so_far(held, keys, [order], "alive", "frozen", parts).join(first, same).withColumn("frozen", F.coalesce("frozen", "began"))
    return out.select(*df.columns, *(F.col(f"frozen.{c}").alias(f"{c}_clean") for c in columns))

"""Clustering and merging of repeated detections of the same kill-feed row.

Tables have match_id, frame, row, player1 (null for a death without killer), player2,
assists, ability, is_critical and is_environmental. (frame, row) is unique in a match.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordwell.session import dealt

KEY = ("match_id", "player2", "is_res", "rescuer")


def is_resurrection(player1: Column, player2: Column) -> Column:
    """Killer and victim are of one team; no killer means a death."""
    return F.coalesce(player1["team"] == player2["team"], F.lit(False))


def match_key(df: DataFrame) -> DataFrame:
    """df with is_res and rescuer: equal (match, victim, is_res, rescuer) is what matches."""
    res = is_resurrection(F.col("player1"), F.col("player2"))
    return df.withColumn("is_res", res).withColumn("rescuer", F.when(res, F.col("player1")))


def islands(df: DataFrame, keys: list, order: list, start: Column, to: str = "island") -> DataFrame:
    """Number the runs of rows, each begun by a row where start holds, per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(to, F.sum(start.cast("int")).over(w))


def resurrection_ranges(df: DataFrame, window: int) -> DataFrame:
    """(match_id, player2, first, last) of each burst of one resurrector's rows, chained by gaps of at most window."""
    rows = match_key(df).where("is_res")
    w = Window.partitionBy("match_id", "player1", "player2").orderBy("frame", "row")
    before = F.lag("frame").over(w)
    rows = rows.withColumn("new", before.isNull() | (F.col("frame") - before > window))
    rows = islands(rows, ["match_id", "player1", "player2"], ["frame", "row"], F.col("new"))
    return rows.groupBy("match_id", "player1", "player2", "island").agg(F.min("frame").alias("first"), F.max("frame").alias("last")).select("match_id", "player1", "player2", "first", "last")


def barriers(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """df (with prev, frame) plus blocked: some range of the victim lies strictly between prev and frame.

    The earliest end among the ranges that start after prev decides. A window over both, from
    the latest down, finds it in one sort: its frame only grows, so a key takes linear time.
    """
    rows = df.withColumn("at", F.coalesce("prev", "frame")).withColumn("end", F.lit(None).cast("int")).withColumn("is_range", F.lit(False))
    marks = ranges.select("match_id", "player2", F.col("first").alias("at"), F.col("last").alias("end"), F.lit(True).alias("is_range"))
    w = Window.partitionBy("match_id", "player2").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("next_end", F.min("end").over(w))
    blocked = F.col("prev").isNotNull() & F.coalesce(F.col("next_end") < F.col("frame"), F.lit(False))
    return both.where("not is_range").withColumn("blocked", blocked).drop("at", "end", "is_range", "next_end")


def clusters(df: DataFrame, window: int, rows: int | None = None) -> DataFrame:
    """df with a cluster number per key: same key, gaps of at most window frames, no barrier between.

    All that follows is by (match, victim) and more, so rows are dealt once; rows says how many there are.
    """
    df = dealt(df, rows, "match_id", "player2")
    keyed = match_key(df)
    w = Window.partitionBy(*KEY).orderBy("frame", "row")
    keyed = barriers(keyed.withColumn("prev", F.lag("frame").over(w)), resurrection_ranges(df, window))
    new = F.col("prev").isNull() | (F.col("frame") - F.col("prev") > window) | F.col("blocked")
    return islands(keyed, list(KEY), ["frame", "row"], new, "cluster").drop("prev", "blocked")


def pieces(frames: list[int], rows: list[int]) -> list[int]:
    """The piece of each row of a cluster sorted by (frame, row); -1 for rows that are dropped.

    Where the victim shows on several rows of a frame, the lowest row from there on is a
    new event, higher rows go on with the old one, and rows below the split are dropped.
    """
    out, left, piece = [0] * len(frames), list(range(len(frames))), 0
    while True:
        twice = next((frames[a] for a, b in zip(left, left[1:], strict=False) if frames[a] == frames[b]), None)
        if twice is None:
            return out
        low = min(rows[i] for i in left if frames[i] == twice)
        piece += 1
        for i in left:
            if frames[i] >= twice and rows[i] <= low:
                out[i] = piece if rows[i] == low else -1
        left = [i for i in left if frames[i] < twice or rows[i] > low]


def split_clusters(df: DataFrame) -> DataFrame:
    """df with piece, the part of its cluster; rows that a split drops are gone.

    Only clusters that have a frame twice leave the JVM.
    """
    keys = [*KEY, "cluster"]
    again = F.coalesce(F.lag("frame").over(Window.partitionBy(*keys).orderBy("frame", "row")) == F.col("frame"), F.lit(False))
    counted = df.withColumn("again", again).withColumn("twice", F.max("again").over(Window.partitionBy(*keys))).drop("again")
    whole = counted.where("not twice").drop("twice").withColumn("piece", F.lit(0))
    others = [c for c in df.columns if c not in keys and c not in ("frame", "row")]
    listed = counted.where("twice").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame", "row", *others))).alias("members"))

    @F.pandas_udf("array<int>")
    def split(members: pd.Series) -> pd.Series:
        return members.map(lambda x: pieces([p["frame"] for p in x], [p["row"] for p in x]))

    at = F.transform("members", lambda m: F.struct(m["frame"].alias("frame"), m["row"].alias("row")))
    placed = listed.withColumn("p", split(at)).select(*keys, F.explode(F.arrays_zip("members", "p")).alias("z")).select(*keys, "z.members.*", F.col("z.p").alias("piece"))
    return whole.unionByName(placed.where("piece >= 0").select(*whole.columns))


def plurality(values: Column) -> Column:
    """(value, votes) with most votes among the non-null elements of an array; the first seen of equals."""
    voters = F.filter(values, lambda v: v.isNotNull())
    counted = F.transform(F.array_distinct(voters), lambda v: F.struct(F.size(F.filter(voters, lambda x: x == v)).alias("votes"), v.alias("value")))
    better = lambda best, c: F.when(best.isNull() | (c["votes"] > best["votes"]), c).otherwise(best)
    return F.reduce(F.slice(counted, 2, 1 << 30), F.get(counted, 0), better)


def majority(flags: Column) -> Column:
    """More than half of all elements are true."""
    return 2 * F.size(F.filter(flags, lambda x: x)) > F.size(flags)


def merge(df: DataFrame, keys: list) -> DataFrame:
    """One row for each group of keys: anchor (frame, row), plurality players, majority ability, flags and assists."""
    fields = ("frame", "row", "player1", "player2", "assists", "ability", "is_critical", "is_environmental")
    all_rows = F.sort_array(F.collect_list(F.struct(*fields)))
    g = df.groupBy(*keys).agg(all_rows.alias("all"))
    col = lambda f: F.transform("all", lambda x: x[f])
    n = F.size("all")
    ability = plurality(col("ability"))
    pairs = F.flatten(col("assists"))
    heroes = F.array_distinct(F.transform(pairs, lambda a: a["hero"]))
    often = F.filter(heroes, lambda h: 2 * F.size(F.filter("all", lambda x: F.exists(x["assists"], lambda a: a["hero"] == h))) > n)
    team = lambda h: plurality(F.transform(F.filter(pairs, lambda a: a["hero"] == h), lambda a: a["team"]))["value"]
    return g.select(
        *keys,
        F.col("all")[0]["frame"].alias("frame"),
        F.col("all")[0]["row"].alias("row"),
        n.alias("n"),
        plurality(col("player1"))["value"].alias("player1"),
        plurality(col("player2"))["value"].alias("merged2"),
        F.transform(often, lambda h: F.struct(team(h).alias("team"), h.alias("hero"))).alias("assists"),
        F.when(2 * ability["votes"] > n, ability["value"]).alias("ability"),
        majority(col("is_critical")).alias("is_critical"),
        majority(col("is_environmental")).alias("is_environmental"),
    )


def deduplicate(df: DataFrame, window: int = 60, rows: int | None = None) -> DataFrame:
    """Distinct events behind detections (so many rows): clustered, split and merged."""
    split = dealt(split_clusters(clusters(df, window, rows)), rows, "match_id", "player2")
    return merge(split, [*KEY, "cluster", "piece"])


class Detections:
    """Detections of matches, to be de-duplicated."""

    def __init__(self, df: DataFrame, window: int = 60, rows: int | None = None):
        self.df, self.window, self.rows = df, window, rows

    def deduplicate(self) -> DataFrame:
        return deduplicate(self.df, self.window, self.rows)

"""Match statistics from timelines: fights, kills, deaths, top players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordwell.dims import FIGHT_GAP, FIGHT_TAIL


def in_match() -> Window:
    return Window.partitionBy("match_id").orderBy("time_s", "event_id")


def eliminations(df: DataFrame, start: float = 0, end: float = 0) -> DataFrame:
    """Kills between start and end; all of them if both are zero."""
    kills = df.where(F.col("action") == "Eliminate")
    return kills if start == end == 0 else kills.where(F.col("time_s").between(start, end))


def separations(df: DataFrame, gap: float = FIGHT_GAP) -> DataFrame:
    """(match_id, separation): 0, and the midpoint of each pause longer than gap between kills."""
    kills = eliminations(df).withColumn("before", F.lag("time_s").over(in_match()))
    between = kills.where(F.col("time_s") - F.col("before") > gap).select("match_id", ((F.col("time_s") + F.col("before")) / 2).alias("separation"))
    return between.unionByName(df.select("match_id").distinct().withColumn("separation", F.lit(0.0)))


def fights(df: DataFrame, gap: float = FIGHT_GAP) -> DataFrame:
    """Kills with fight, a number from 1 in each match."""
    kills = eliminations(df)
    before = F.lag("time_s").over(in_match())
    new = F.coalesce(F.col("time_s") - before > gap, F.lit(True)).cast("int")
    return kills.withColumn("new", new).withColumn("fight", F.sum("new").over(in_match())).drop("new")


def fight_index(df: DataFrame, gap: float = FIGHT_GAP) -> DataFrame:
    """df with fight, how many separations aren't later than the event: a boundary goes to the later fight."""
    marks = separations(df, gap).select("match_id", F.col("separation").alias("time_s"), F.lit(1).alias("mark"))
    both = df.withColumn("mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("match_id").orderBy("time_s").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("fight", F.sum("mark").over(w)).where("mark = 0").drop("mark")


def fight_spans(df: DataFrame, gap: float = FIGHT_GAP) -> DataFrame:
    """One row for each fight: first, last, duration, kills."""
    return fights(df, gap).groupBy("match_id", "fight").agg(
        F.min("time_s").alias("first"), F.max("time_s").alias("last"), F.count("*").alias("kills"), (F.max("time_s") - F.min("time_s") + FIGHT_TAIL).alias("duration")
    )


def net_deaths(action: Column) -> Column:
    return F.sum(F.when(action.isin("Eliminate", "Suicide"), 1).when(action == "Resurrect", -1).otherwise(0))


def top(df: DataFrame, keys: list[str], score: str, seen: str, take: list[str]) -> DataFrame:
    """The row with the greatest score of each key; of equals the first seen."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*take), F.struct(F.col(score), -F.col(seen))).alias("t")).select(*keys, "t.*")


def kills_by_player(df: DataFrame) -> DataFrame:
    return eliminations(df).groupBy("match_id", "subject").agg(F.count("*").alias("kills"), F.min(F.col("event_id")).alias("seen"))


def kill_death(df: DataFrame) -> DataFrame:
    """Kills, deaths and their ratio (deaths count one at least) of each player seen."""
    roles = eliminations(df).select("match_id", "event_id", F.explode(F.array(F.struct(F.col("subject").alias("slot"), F.lit(1).alias("k"), F.lit(0).alias("d")), F.struct(F.col("object").alias("slot"), F.lit(0).alias("k"), F.lit(1).alias("d")))).alias("r"))
    g = roles.groupBy("match_id", F.col("r.slot").alias("slot")).agg(F.sum("r.k").alias("kills"), F.sum("r.d").alias("deaths"), F.min("event_id").alias("seen"))
    return g.withColumn("ratio", F.col("kills") / F.greatest("deaths", F.lit(1)))


class MatchStats:
    """Statistics of matches from a timeline and, where given, state series."""

    def __init__(self, events: DataFrame, states: DataFrame | None = None, gap: float = FIGHT_GAP):
        self.events, self.states, self.gap = events, states, gap

    def eliminations(self, start: float = 0, end: float = 0) -> DataFrame:
        return eliminations(self.events, start, end)

    def fights(self) -> DataFrame:
        return fight_spans(self.events, self.gap)

    def separations(self) -> DataFrame:
        return separations(self.events, self.gap)

    def mean_fight(self) -> DataFrame:
        return self.fights().groupBy("match_id").agg(F.avg("duration").alias("duration"))

    def kills(self) -> DataFrame:
        return kills_by_player(self.events)

    def top_killer(self) -> DataFrame:
        return top(self.kills(), ["match_id"], "kills", "seen", ["subject", "kills"])

    def top_ratio(self) -> DataFrame:
        return top(kill_death(self.events), ["match_id"], "ratio", "seen", ["slot", "ratio"])

    def more_eliminations(self, before: DataFrame, start: float, end: float) -> DataFrame:
        """An earlier result with the kills of another range behind it."""
        return before.unionByName(self.eliminations(start, end))

    def fight_index(self) -> DataFrame:
        return fight_index(self.events, self.gap)

    def all_fights(self) -> DataFrame:
        """(match_id, fight, kills): each fight's kills in order."""
        own = F.sort_array(F.collect_list(F.struct("time_s", "event_id", "subject", "object")))
        return fights(self.events, self.gap).groupBy("match_id", "fight").agg(own.alias("kills"))

    def fight_count(self) -> DataFrame:
        return self.fights().groupBy("match_id").agg(F.count("*").alias("fights"))

    def elimination_count(self, start: float = 0, end: float = 0) -> DataFrame:
        return self.eliminations(start, end).groupBy("match_id").agg(F.count("*").alias("kills"))

    def death_count(self) -> DataFrame:
        """Kills and suicides less resurrections."""
        return self.events.groupBy("match_id").agg(net_deaths(F.col("action")).alias("deaths"))

    def duration(self) -> DataFrame:
        return self.states.groupBy("match_id").agg(F.max_by("time", "frame").alias("duration"))

    def state_range(self, start: float, end: float) -> DataFrame:
        """State rows between two times, both included."""
        return self.states.where(F.col("time").between(start, end))

    def charge_delta_sum(self, ranges: list[tuple[int, int]]) -> DataFrame:
        """The charge gained from first to last frame of each range, summed."""
        out = self.charge_delta(*ranges[0])
        for r in ranges[1:]:
            out = out.unionByName(self.charge_delta(*r))
        return out.groupBy("match_id", "slot").agg(F.sum("delta").alias("delta"))

    def charge_delta(self, start: int, end: int) -> DataFrame:
        s = self.states.where(F.col("frame").isin(start, end)).groupBy("match_id", "slot")
        return s.agg((F.max_by("ult_charge", "frame") - F.min_by("ult_charge", "frame")).alias("delta"))

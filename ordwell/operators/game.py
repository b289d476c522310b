"""A match from frames to tables: the cleaning passes in their order, then timeline, line-ups and states.

Inputs: states (match_id, slot, frame, time, hero, is_dead, is_ult_ready, ult_charge),
frames (match_id, frame, time, is_valid, is_replay) and kills (match_id, frame, row,
killer_team, killer, victim_team, victim, is_res; killer may be null). Slots 0 to 5 are
team 0. Nothing is overwritten: each pass gives new tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordwell.dims import OBJECT_HERO
from ordwell.functions.text import owner
from ordwell.operators import states as s
from ordwell.operators.matching import asof
from ordwell.session import cut_as_dealt as cut
from ordwell.session import parts_for
from ordwell.sources.archives import rows_of, write_archives


@dataclass(frozen=True)
class Rules:
    """Frames a second, seconds a replay's effect lasts, the hero with a mech and the mech's name, and the longest step to a death seen again."""

    fps: float = 2.0
    effect: float = 2.0
    mech_hero: str = "dva"
    mech: str = "meka"
    again: float = 1.2

    @property
    def step(self) -> float:
        return 1 / self.fps

    @property
    def span(self) -> int:
        return max(1, round(self.fps))


def by_match() -> Window:
    return Window.partitionBy("match_id").orderBy("frame")


def clear_frames(frames: DataFrame, rules: Rules) -> DataFrame:
    """(match_id, frame) of the frames to keep: valid, not in a gap between invalid ones, no replay just before."""
    k = ceil(rules.effect * rules.fps)
    gap = F.coalesce(~F.lag("is_valid", k + 1).over(by_match()) & ~F.col("is_valid"), F.lit(False))
    marked = frames.withColumn("gap", gap).withColumn("number", F.row_number().over(by_match()))
    inside = F.max("gap").over(by_match().rowsBetween(0, k + 1))
    replayed = F.max("is_replay").over(by_match().rowsBetween(-k, 0)) & (F.col("number") > k)
    return marked.withColumn("keep", F.col("is_valid") & ~inside & ~replayed).where("keep").select("match_id", "frame")


def renamed(df: DataFrame, before: list[str], **columns: str) -> DataFrame:
    """df with columns taken from others of its own, in the order before, new ones last."""
    # a column that keeps its name isn't aliased: behind cut_as_dealt Spark wouldn't know it as the one rows are dealt by
    return df.select(*(F.col(columns[c]).alias(c) if c in columns else c for c in before), *(F.col(v).alias(c) for c, v in columns.items() if c not in before))


def smoothed(states: DataFrame, parts: int) -> DataFrame:
    others = tuple(c for c in states.columns if c not in (*s.SERIES, "frame", "hero"))
    return renamed(s.smooth(states, carry=others, parts=parts), states.columns, hero="hero_clean")


def frozen(states: DataFrame) -> DataFrame:
    kept = ("hero", "ult_charge", "is_ult_ready")
    return renamed(s.freeze_while_dead(states, *kept), states.columns, **{c: f"{c}_clean" for c in kept})


def is_object(name: Column, rules: Rules) -> Column:
    """The name is of something that belongs to a hero, not of a hero."""
    return F.coalesce(name.isin(rules.mech, *OBJECT_HERO), F.lit(False))


def owned_by(name: Column, rules: Rules) -> Column:
    return F.when(name == rules.mech, rules.mech_hero).otherwise(owner(name))


def rematched(kills: DataFrame, states: DataFrame, alive: bool, rules: Rules) -> DataFrame:
    """kills with killer_slot and victim_slot: who last had that hero (or an object's owner) on that side, up to the frame; -1 if nobody had."""
    had = states.where("not is_dead") if alive else states
    had = had.groupBy("match_id", F.when(F.col("slot") < 6, 0).otherwise(1).alias("team"), "hero", "frame").agg(F.min("slot").alias("slot"))
    out = kills.drop("killer_slot", "victim_slot")
    for role in ("killer", "victim"):
        side = had.select("match_id", F.col("team").alias(f"{role}_team"), F.col("hero").alias("had_by"), "frame", F.col("slot").alias(f"{role}_slot"))
        out = asof(out.withColumn("had_by", owned_by(F.col(role), rules)), side, ["match_id", f"{role}_team", "had_by"], "frame", [f"{role}_slot"]).drop("had_by")
    return out.withColumns({f"{r}_slot": F.coalesce(f"{r}_slot", F.lit(-1)) for r in ("killer", "victim")})


def with_deaths(states: DataFrame, kills: DataFrame, rules: Rules, parts: int) -> DataFrame:
    """states with is_dead worked out from the kills of each slot; who loses an object lives on."""
    own = kills.where((F.col("victim_slot") >= 0) & ~is_object(F.col("victim"), rules)).groupBy("match_id", F.col("victim_slot").alias("slot"), "frame").agg(F.sort_array(F.collect_list(F.struct("row", F.when(F.col("is_res"), "res").otherwise("kill").alias("kind")))).alias("own"))
    told = states.join(own, [*s.SERIES, "frame"], "left").withColumn("kills", F.coalesce(F.transform("own", lambda x: x["kind"]), F.array().cast("array<string>")))
    others = tuple(c for c in states.columns if c not in (*s.SERIES, "frame", "is_dead"))
    return renamed(s.death_series(told, rules.step, others, parts), states.columns, is_dead="is_dead_clean")


def repaired(states: DataFrame, kills: DataFrame, rules: Rules, parts: int) -> DataFrame:
    """states smoothed, frozen, with mech_status and both ready flags, charges repaired and smoothed again; a mech is down when it is itself a row's victim."""
    down = kills.where((F.col("victim_slot") >= 0) & (F.col("victim") == rules.mech)).select("match_id", F.col("victim_slot").alias("slot"), "frame", F.lit(True).alias("is_down")).distinct()
    told = states.join(down, [*s.SERIES, "frame"], "left").withColumn("is_down", F.coalesce("is_down", F.lit(False)))
    others = tuple(c for c in states.columns if c not in (*s.SERIES, "frame", "hero", "ult_charge", "is_ult_ready"))
    clean = {c: f"{c}_clean" for c in ("hero", "ult_charge", "is_ult_ready")}
    return renamed(s.last_repairs(told, rules.span, rules.mech_hero, others, parts), states.columns, **clean, mech_status="mech_status", is_secondary_ult_ready="is_secondary_ult_ready")


def clear_kills(kills: DataFrame, states: DataFrame, rules: Rules) -> DataFrame:
    """kills without those whose victim was dead two frames before, and a frame's first row where it repeats the last row of the frame before."""
    w = s.series()
    before = states.select("match_id", F.col("slot").alias("victim_slot"), "frame", F.lag("is_dead", 2).over(w).alias("was_dead"), (F.col("time") - F.lag("time", 2).over(w)).alias("since"))
    told = kills.join(before, ["match_id", "victim_slot", "frame"], "left")
    known = F.coalesce(F.col("was_dead") & (F.col("since") <= rules.again) & ~F.col("is_res") & ~is_object(F.col("victim"), rules), F.lit(False))
    order = Window.partitionBy("match_id").orderBy("frame", "row")
    pair, last = F.struct("killer_team", "killer", "victim_team", "victim"), F.lag(F.struct("frame", F.struct("killer_team", "killer", "victim_team", "victim").alias("pair"))).over(order)
    marked = told.withColumn("last", last)
    again = F.coalesce((F.col("last.frame") < F.col("frame")) & F.col("last.pair").eqNullSafe(pair), F.lit(False))
    return marked.where(~again & ~known).select(*kills.columns)


def postprocess(states: DataFrame, frames: DataFrame, kills: DataFrame, rules: Rules | None = None, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(states, kills) after all passes, in this order.

    All passes work inside a match: the tables are dealt by match, in parts that follow the number
    of rows of states, and shuffled again only behind the three folds. Tables that came dealt so stay as they are.
    """
    rules = rules or Rules()
    parts = parts_for(states.sparkSession, rows)
    states, frames, kills = (x.repartition(parts, "match_id") for x in (states, frames, kills))
    kept = clear_frames(frames, rules)
    states, kills = states.join(kept, ["match_id", "frame"]).select(*states.columns), kills.join(kept, ["match_id", "frame"]).select(*kills.columns)
    # tables that several later passes use are written once; without that each use would repeat all passes before it
    states = cut(smoothed(states, parts))
    kills = cut(rematched(kills, states, False, rules))
    states = cut(frozen(with_deaths(states, kills, rules, parts)))
    kills = cut(rematched(kills, states, True, rules))
    states = cut(repaired(states, kills, rules, parts))
    return states, cut(clear_kills(kills, states, rules))


def action(is_res: Column, killer: Column, victim: Column, rules: Rules) -> Column:
    return F.when(is_res, "Resurrect").when(victim == rules.mech, "Demech").when(killer.isNull(), "Suicide").otherwise("Eliminate")


def timeline(states: DataFrame, kills: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(match_id, time, frame, phase, ordinal, action, subject, object) of switches, kills and ultimates, to be ordered by the first five."""
    rules = rules or Rules()
    times = states.groupBy("match_id", "frame").agg(F.min("time").alias("time"))
    kill = kills.join(times, ["match_id", "frame"]).select("match_id", "time", "frame", F.lit(1).alias("phase"), F.col("row").alias("ordinal"), action(F.col("is_res"), F.col("killer"), F.col("victim"), rules).alias("action"), F.col("killer_slot").alias("subject"), F.col("victim_slot").alias("object"))
    switch = s.hero_switches(states).select("match_id", F.col("event_time").alias("time"), "frame", F.lit(0).alias("phase"), F.col("slot").alias("ordinal"), F.concat(F.lit("Switch from "), "from_hero", F.lit(" to "), "to_hero").alias("action"), F.col("slot").alias("subject"), F.lit(None).cast("int").alias("object"))
    ults = s.ult_transitions(states, rules.mech_hero).join(times, ["match_id", "frame"]).select("match_id", "time", "frame", F.lit(2).alias("phase"), F.col("slot").alias("ordinal"), F.when(F.col("event") == s.MECH_UP, s.MECH_UP).otherwise(F.concat(F.lit("Ultimate "), "event")).alias("action"), F.col("slot").alias("subject"), F.lit(None).cast("int").alias("object"))
    return switch.unionByName(kill).unionByName(ults)


def lineups(states: DataFrame) -> DataFrame:
    """(match_id, slot, starting, final, charge)."""
    return states.groupBy(*s.SERIES).agg(F.min_by("hero", "frame").alias("starting"), F.max_by("hero", "frame").alias("final"), F.concat(F.max_by("ult_charge", "frame").cast("string"), F.lit("%")).alias("charge"))


def state_table(states: DataFrame) -> DataFrame:
    """(match_id, frame, players): the slots' hero, health and charge in order."""
    each = F.struct("slot", "hero", F.when(F.col("is_dead"), 0).otherwise(100).alias("hps"), F.col("ult_charge").alias("ults"))
    return states.groupBy("match_id", "frame").agg(F.sort_array(F.collect_list(each)).alias("players"))


@dataclass
class Game:
    """A match's, or many matches', tables: analyse once, then output."""

    states: DataFrame
    frames: DataFrame
    kills: DataFrame
    rules: Rules = Rules()
    #: Rows of states, if known.
    rows: int = 0

    def analyse(self) -> dict[str, DataFrame]:
        """The three result tables and the cleaned rows behind them."""
        states, kills = postprocess(self.states, self.frames, self.kills, self.rules, self.rows)
        return {"timeline": timeline(states, kills, self.rules), "lineups": lineups(states), "states": state_table(states), "player_frames": states, "kills": kills}

    def output(self, path: str) -> dict[str, DataFrame]:
        """analyse(), and an archive for each match at <path>/<match_id>.zip."""
        found = self.analyse()
        parts = [
            rows_of(found["player_frames"], "frames", "frame", "slot"),
            rows_of(found["timeline"], "data_sheet1", "time", "frame", "phase", "ordinal"),
            rows_of(found["lineups"], "data_sheet2", "slot"),
            rows_of(found["states"], "data_sheet3", "frame"),
        ]
        write_archives(reduce(DataFrame.unionByName, parts), path)
        return found

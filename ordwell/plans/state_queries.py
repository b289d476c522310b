"""Queries over state series and their joins with events, with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ordwell.operators import states as s
from ordwell.plans.registry import ORACLES, query
from ordwell.functions.text import rounded
from ordwell.operators import game, scans
from ordwell.sources.adapters import PF, player_frames

W = "WINDOW w AS (PARTITION BY match_id, slot ORDER BY frame)"
KEY = "match_id, CAST(slot AS INTEGER) AS slot, CAST(frame AS INTEGER) AS frame"
pf = player_frames


@query("f5_freeze_ffill", f"""WITH {PF},
b AS (SELECT *, max(CASE WHEN NOT is_dead OR frame = 0 THEN frame END) OVER (PARTITION BY match_id, slot ORDER BY frame) AS base FROM pf)
SELECT b.match_id, CAST(b.slot AS INTEGER) AS slot, CAST(b.frame AS INTEGER) AS frame, p.hero AS hero_clean, p.ult_charge AS ult_charge_clean
FROM b JOIN pf p ON p.match_id = b.match_id AND p.slot = b.slot AND p.frame = b.base""")
def f5(spark, sf_dir):
    return s.freeze_while_dead(pf(spark, sf_dir), "hero", "ult_charge").select(*s.SERIES, "frame", "hero_clean", "ult_charge_clean")


@query("f4_smooth", f"""WITH RECURSIVE {PF},
n AS (SELECT *, lead(hero) OVER w AS nx FROM pf {W}),
r AS (
  SELECT match_id, slot, frame, hero AS hero_clean FROM n WHERE frame = 0
  UNION ALL
  SELECT n.match_id, n.slot, n.frame, CASE WHEN n.nx IS NOT NULL AND r.hero_clean = n.nx AND n.hero <> r.hero_clean THEN r.hero_clean ELSE n.hero END
  FROM r JOIN n ON n.match_id = r.match_id AND n.slot = r.slot AND n.frame = r.frame + 1)
SELECT {KEY}, hero_clean FROM r""")
def f4(spark, sf_dir):
    return s.smooth(pf(spark, sf_dir))


@query("f10_hero_switch", f"""WITH {PF}, x AS (SELECT *, lag(hero) OVER w AS p, lead(hero) OVER w AS n FROM pf {W})
SELECT {KEY}, time - 1.5 AS event_time, p AS from_hero, hero AS to_hero FROM x WHERE p <> hero AND hero = n""")
def f10(spark, sf_dir):
    return s.hero_switches(pf(spark, sf_dir))


@query("f11_ult_transitions", f"""WITH {PF}, x AS (SELECT *, coalesce(lag(is_ult_ready) OVER w, false) AS p FROM pf {W})
SELECT {KEY}, CASE WHEN is_ult_ready THEN 'ready' WHEN hero = 'h0' AND ult_charge % 3 = 1 THEN 'Meka up' ELSE 'used' END AS event FROM x WHERE p <> is_ult_ready""")
def f11(spark, sf_dir):
    return s.ult_transitions(pf(spark, sf_dir).withColumn("mech_status", F.when(F.col("ult_charge") % 3 == 1, 1).otherwise(0)), "h0")


@query("f12_lineup", f"WITH {PF} SELECT match_id, CAST(slot AS INTEGER) AS slot, arg_min(hero, frame) AS starting, arg_max(hero, frame) AS final, arg_max(ult_charge, frame) || '%' AS charge FROM pf GROUP BY match_id, slot")
def f12(spark, sf_dir):
    return pf(spark, sf_dir).groupBy(*s.SERIES).agg(F.min_by("hero", "frame").alias("starting"), F.max_by("hero", "frame").alias("final"), F.concat(F.max_by("ult_charge", "frame").cast("string"), F.lit("%")).alias("charge"))


@query("f13_final_lineup", f"WITH {PF} SELECT match_id, CAST(slot AS INTEGER) AS slot, arg_max(hero, frame) AS final FROM pf GROUP BY match_id, slot")
def f13(spark, sf_dir):
    return pf(spark, sf_dir).groupBy(*s.SERIES).agg(F.max_by("hero", "frame").alias("final"))


@query("f14_final_charge", f"WITH {PF} SELECT match_id, CAST(slot AS INTEGER) AS slot, arg_max(ult_charge, frame) || '%' AS charge FROM pf GROUP BY match_id, slot")
def f14(spark, sf_dir):
    return pf(spark, sf_dir).groupBy(*s.SERIES).agg(F.concat(F.max_by("ult_charge", "frame").cast("string"), F.lit("%")).alias("charge"))


@query("f18_lookback_flags", f"""WITH {PF},
x AS (SELECT *, coalesce(lag(is_ult_ready) OVER w AND NOT is_ult_ready, false) AS u, coalesce(lag(hero) OVER w <> hero, false) AS h FROM pf {W})
SELECT {KEY}, max(u) OVER (PARTITION BY match_id, slot ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS used,
  max(h) OVER (PARTITION BY match_id, slot ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS switched FROM x""")
def f18(spark, sf_dir):
    w = s.series()
    used = F.coalesce(F.lag("is_ult_ready").over(w) & ~F.col("is_ult_ready"), F.lit(False))
    x = pf(spark, sf_dir).withColumn("u", used).withColumn("h", F.coalesce(F.lag("hero").over(w) != F.col("hero"), F.lit(False)))
    return x.select(*s.SERIES, "frame", s.lookback(F.col("u"), 4).alias("used"), s.lookback(F.col("h"), 4, 3).alias("switched"))


@query("f6_death_state")
def f6(spark, sf_dir):
    p = pf(spark, sf_dir)
    kills = F.when(F.col("ult_charge") % 29 == 0, F.array(F.lit("kill"))).when(F.col("ult_charge") % 31 == 0, F.array(F.lit("res"))).otherwise(F.array().cast("array<string>"))
    return s.death_series(p.withColumn("kills", kills))


@query("f7_charge_repair")
def f7(spark, sf_dir):
    return s.repaired_charges(pf(spark, sf_dir), mech_hero="h0")


@query("f9_mech")
def f9(spark, sf_dir):
    return s.mech_statuses(pf(spark, sf_dir).withColumn("is_down", F.col("ult_charge") % 17 == 0), mech_hero="h0")


# Frames of a match, for validity and replays: is_replay and is_valid from slot 0's state.
FRAMES = """fr AS (SELECT match_id, frame, time, ult_charge % 11 = 0 AS is_replay, ult_charge % 13 <> 0 AS is_valid FROM pf WHERE slot = 0)"""
KF = "match_id, CAST(frame AS INTEGER) AS frame"


def frames(spark, sf_dir):
    return pf(spark, sf_dir).where("slot = 0").select("match_id", "frame", "time", (F.col("ult_charge") % 11 == 0).alias("is_replay"), (F.col("ult_charge") % 13 != 0).alias("is_valid"))


def match():
    return Window.partitionBy("match_id").orderBy("frame")


@query("c1_valid_frames", f"WITH {PF}, {FRAMES} SELECT {KF} FROM fr WHERE is_valid")
def c1(spark, sf_dir):
    return frames(spark, sf_dir).where("is_valid").select("match_id", "frame")


@query("c2_replay_tail", f"""WITH {PF}, {FRAMES}, x AS (
  SELECT *, max(is_replay) OVER (PARTITION BY match_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r, row_number() OVER (PARTITION BY match_id ORDER BY frame) AS n FROM fr)
SELECT {KF} FROM x WHERE is_valid AND (n <= 4 OR NOT r)""")
def c2(spark, sf_dir):
    w = match()
    x = frames(spark, sf_dir).withColumn("r", F.max("is_replay").over(w.rowsBetween(-4, 0))).withColumn("n", F.row_number().over(w))
    return x.where("is_valid and (n <= 4 or not r)").select("match_id", "frame")


@query("c3_gap_invalidation", f"""WITH {PF}, {FRAMES},
g AS (SELECT match_id, frame - 5 AS a, frame AS z FROM (SELECT *, lag(is_valid, 5) OVER (PARTITION BY match_id ORDER BY frame) AS p FROM fr) WHERE NOT p AND NOT is_valid)
SELECT {KF}, is_valid AND NOT EXISTS (SELECT 1 FROM g WHERE g.match_id = fr.match_id AND fr.frame BETWEEN g.a AND g.z) AS is_valid_clean FROM fr""")
def c3(spark, sf_dir):
    w = match()
    gap = F.coalesce(~F.lag("is_valid", 5).over(w) & ~F.col("is_valid"), F.lit(False))
    x = frames(spark, sf_dir).withColumn("g", gap)
    inside = F.max("g").over(w.rowsBetween(0, 5))
    return x.select("match_id", "frame", (F.col("is_valid") & ~inside).alias("is_valid_clean"))


@query("c4_frame_validity", f"WITH {PF} SELECT {KF}, bool_or(NOT is_dead) AND avg(ult_charge) > 20 AND stddev_pop(ult_charge) > 1 AS valid FROM pf GROUP BY match_id, frame")
def c4(spark, sf_dir):
    ok = F.bool_or(~F.col("is_dead")) & (F.avg("ult_charge") > 20) & (F.stddev_pop("ult_charge") > 1)
    return pf(spark, sf_dir).groupBy("match_id", "frame").agg(ok.alias("valid"))


KILLS = """k AS (SELECT event_id, user_id // 30 AS match_id, CAST(user_id % 12 AS INTEGER) AS slot, event_id % 40 AS frame, 'h' || (event_id % 3) AS hero, event_type = 'signup' AS is_res FROM events)"""


def kills(spark, sf_dir):
    """Kill rows with a victim slot and a hero seen, in the frames of a match."""
    from ordwell.session import table

    return table(spark, sf_dir, "events").select(
        "event_id", F.expr("user_id div 30").alias("match_id"), F.expr("cast(user_id % 12 as int)").alias("slot"), F.expr("cast(event_id % 40 as int)").alias("frame"),
        F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("hero"), (F.col("event_type") == "signup").alias("is_res"),
    )


@query("c7_dead_victim", f"""WITH {PF}, {KILLS}, x AS (SELECT *, lag(is_dead, 2) OVER w AS d2, time - lag(time, 2) OVER w AS dt FROM pf {W})
SELECT k.event_id FROM k LEFT JOIN x ON x.match_id = k.match_id AND x.slot = k.slot AND x.frame = k.frame
WHERE NOT (coalesce(x.d2, false) AND NOT k.is_res AND coalesce(x.dt, 9) <= 1.2)""")
def c7(spark, sf_dir):
    w = s.series()
    x = pf(spark, sf_dir).select(*s.SERIES, "frame", F.lag("is_dead", 2).over(w).alias("d2"), (F.col("time") - F.lag("time", 2).over(w)).alias("dt"))
    j = kills(spark, sf_dir).join(x, [*s.SERIES, "frame"], "left")
    return j.where(~(F.coalesce("d2", F.lit(False)) & ~F.col("is_res") & (F.coalesce("dt", F.lit(9.0)) <= 1.2))).select("event_id")


@query("dj1_asof_rematch", f"""WITH {PF}, {KILLS},
b AS (SELECT match_id, frame, hero, min(slot) AS slot FROM pf WHERE NOT is_dead AND slot < 6 GROUP BY ALL)
SELECT k.event_id, CAST(coalesce(b.slot, -1) AS INTEGER) AS slot FROM k ASOF LEFT JOIN b ON k.match_id = b.match_id AND k.hero = b.hero AND k.frame >= b.frame""")
def dj1(spark, sf_dir):
    from ordwell.operators.matching import asof

    b = pf(spark, sf_dir).where("not is_dead and slot < 6").groupBy("match_id", "hero", "frame").agg(F.min("slot").alias("found"))
    out = asof(kills(spark, sf_dir), b, ["match_id", "hero"], "frame", ["found"])
    return out.select("event_id", F.coalesce("found", F.lit(-1)).alias("slot"))


@query("dj2_rematch_all", f"""WITH {PF}, {KILLS},
b AS (SELECT match_id, frame, hero, min(slot) AS slot FROM pf WHERE slot < 6 GROUP BY ALL),
p AS (SELECT event_id, match_id, frame, unnest([hero, 'h' || ((event_id + 1) % 3)]) AS hero, unnest([0, 1]) AS role FROM k WHERE frame > 0)
SELECT p.event_id, string_agg(coalesce(b.slot, -1)::VARCHAR, ',' ORDER BY p.role) AS slots FROM p ASOF LEFT JOIN b ON p.match_id = b.match_id AND p.hero = b.hero AND p.frame >= b.frame GROUP BY p.event_id""")
def dj2(spark, sf_dir):
    from ordwell.operators.matching import asof

    b = pf(spark, sf_dir).where("slot < 6").groupBy("match_id", "hero", "frame").agg(F.min("slot").alias("found"))
    other = F.concat(F.lit("h"), ((F.col("event_id") + 1) % 3).cast("string"))
    p = kills(spark, sf_dir).where("frame > 0").select("event_id", "match_id", "frame", F.posexplode(F.array("hero", other)).alias("role", "hero"))
    out = asof(p, b, ["match_id", "hero"], "frame", ["found"]).groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("role", F.coalesce("found", F.lit(-1)).alias("s")))).alias("l"))
    return out.select("event_id", F.array_join(F.transform("l", lambda x: x["s"].cast("string")), ",").alias("slots"))


@query("dj3_slot_lookup", f"WITH {PF}, {KILLS}, b AS (SELECT match_id, frame, hero, min(slot) AS s FROM pf WHERE slot < 6 GROUP BY ALL) SELECT k.event_id, CAST(b.s AS INTEGER) AS found FROM k LEFT JOIN b ON b.match_id = k.match_id AND b.frame = k.frame AND b.hero = k.hero")
def dj3(spark, sf_dir):
    b = pf(spark, sf_dir).where("slot < 6").groupBy("match_id", "frame", "hero").agg(F.min("slot").alias("found"))
    return kills(spark, sf_dir).join(b, ["match_id", "frame", "hero"], "left").select("event_id", "found")


@query("dj8_interval_fill", f"""WITH {PF}, {KILLS}
SELECT {KEY}, EXISTS (SELECT 1 FROM k WHERE k.match_id = pf.match_id AND k.slot = pf.slot AND NOT k.is_res AND pf.frame BETWEEN k.frame - 1 AND k.frame + 20) AS is_dead_filled FROM pf""")
def dj8(spark, sf_dir):
    from ordwell.operators.matching import covered

    k = kills(spark, sf_dir).where("not is_res").select(*s.SERIES, (F.col("frame") - 1).alias("first"), (F.col("frame") + 20).alias("last"))
    return covered(pf(spark, sf_dir), k, list(s.SERIES), "frame", "is_dead_filled").select(*s.SERIES, "frame", "is_dead_filled")


# the same by scans in two levels, for keys that may hold any share of all rows
@query("dj1_asof_spread", ORACLES["dj1_asof_rematch"])
def dj1_spread(spark, sf_dir):
    b = pf(spark, sf_dir).where("not is_dead and slot < 6").groupBy("match_id", "hero", "frame").agg(F.min("slot").alias("found"))
    out = scans.asof_spread(kills(spark, sf_dir), b, ["match_id", "hero"], "frame", ["found"])
    return out.select("event_id", F.coalesce("found", F.lit(-1)).alias("slot"))


@query("dj8_fill_spread", ORACLES["dj8_interval_fill"])
def dj8_spread(spark, sf_dir):
    k = kills(spark, sf_dir).where("not is_res").select(*s.SERIES, (F.col("frame") - 1).alias("first"), (F.col("frame") + 20).alias("last"))
    return scans.covered_spread(pf(spark, sf_dir), k, list(s.SERIES), "frame", "is_dead_filled").select(*s.SERIES, "frame", "is_dead_filled")


@query("f5_freeze_spread", ORACLES["f5_freeze_ffill"])
def f5_spread(spark, sf_dir):
    out = scans.freeze_spread(pf(spark, sf_dir), list(s.SERIES), "frame", "is_dead", ["hero", "ult_charge"])
    return out.select(*s.SERIES, "frame", "hero_clean", "ult_charge_clean")


@query("dj9_fill_to_end", f"""WITH {PF}, {KILLS}, e AS (SELECT match_id, slot, min(frame) AS f FROM k WHERE is_res GROUP BY ALL), n AS (SELECT match_id, slot, max(frame) AS z FROM pf GROUP BY ALL)
SELECT pf.match_id, CAST(pf.slot AS INTEGER) AS slot, CAST(pf.frame AS INTEGER) AS frame, coalesce(pf.frame >= e.f AND pf.frame < n.z, false) AS alive_after FROM pf JOIN n USING (match_id, slot) LEFT JOIN e USING (match_id, slot)""")
def dj9(spark, sf_dir):
    e = kills(spark, sf_dir).where("is_res").groupBy(*s.SERIES).agg(F.min("frame").alias("f"))
    x = pf(spark, sf_dir).withColumn("z", F.max("frame").over(Window.partitionBy(*s.SERIES))).join(e, list(s.SERIES), "left")
    return x.select(*s.SERIES, "frame", F.coalesce((F.col("frame") >= F.col("f")) & (F.col("frame") < F.col("z")), F.lit(False)).alias("alive_after"))


@query("dj12_exists_between", f"""WITH {KILLS}, x AS (SELECT *, lag(frame) OVER (PARTITION BY match_id, slot ORDER BY frame, event_id) AS p FROM k WHERE NOT is_res)
SELECT event_id, p IS NOT NULL AND EXISTS (SELECT 1 FROM k r WHERE r.is_res AND r.match_id = x.match_id AND r.slot = x.slot AND r.frame > x.p AND r.frame <= x.frame) AS revived FROM x""")
def dj12(spark, sf_dir):
    k = kills(spark, sf_dir)
    w = Window.partitionBy(*s.SERIES).orderBy("frame", "event_id")
    x = k.where("not is_res").withColumn("p", F.lag("frame").over(w))
    # the latest resurrection up to the frame decides: it lies in (p, frame] or none does
    wide = Window.partitionBy(*s.SERIES).orderBy("frame").rangeBetween(Window.unboundedPreceding, 0)
    both = x.unionByName(k.where("is_res").withColumn("p", F.lit(None).cast("int"))).withColumn("r", F.max(F.when(F.col("is_res"), F.col("frame"))).over(wide))
    return both.where("not is_res").select("event_id", (F.col("p").isNotNull() & F.coalesce(F.col("r") > F.col("p"), F.lit(False))).alias("revived"))


@query("dj13_two_point", f"WITH {PF.replace('pf AS (', 'pf AS MATERIALIZED (')} SELECT a.match_id, CAST(a.slot AS INTEGER) AS slot, b.ult_charge - a.ult_charge AS delta FROM pf a JOIN pf b ON a.match_id = b.match_id AND a.slot = b.slot AND a.frame = 5 AND b.frame = 20")
def dj13(spark, sf_dir):
    p = pf(spark, sf_dir).where("frame in (5, 20)").select(*s.SERIES, "frame", "ult_charge")
    a, b = p.where("frame = 5"), p.where("frame = 20").withColumnRenamed("ult_charge", "later")
    return a.join(b, list(s.SERIES)).select(*s.SERIES, (F.col("later") - F.col("ult_charge")).alias("delta"))


@query("dj10_frame_slots", f"WITH {PF}, f AS (SELECT DISTINCT match_id, frame FROM pf) SELECT match_id, CAST(frame AS INTEGER) AS frame, CAST(slot AS INTEGER) AS slot FROM f, (SELECT unnest(range(12)) AS slot)")
def dj10(spark, sf_dir):
    f = pf(spark, sf_dir).select("match_id", "frame").distinct()
    return f.select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("slot"))


@query("c6_state_range", f"WITH {PF} SELECT {KEY} FROM pf WHERE time BETWEEN 2 AND 6.5")
def c6(spark, sf_dir):
    return pf(spark, sf_dir).where("time between 2 and 6.5").select(*s.SERIES, "frame")


@query("c16_side", f"WITH {PF} SELECT match_id, CASE WHEN slot < 6 THEN 0 ELSE 1 END AS side, count(*) AS n FROM pf GROUP BY ALL")
def c16(spark, sf_dir):
    return pf(spark, sf_dir).groupBy("match_id", F.when(F.col("slot") < 6, 0).otherwise(1).alias("side")).agg(F.count("*").alias("n"))


@query("e16_charge_delta", f"WITH {PF} SELECT match_id, CAST(slot AS INTEGER) AS slot, CAST(max(ult_charge) FILTER (frame = 10) - max(ult_charge) FILTER (frame = 2) AS INTEGER) AS delta FROM pf WHERE frame IN (2, 10) GROUP BY match_id, slot HAVING count(*) = 2")
def e16(spark, sf_dir):
    at = lambda f: F.max(F.when(F.col("frame") == f, F.col("ult_charge")))
    g = pf(spark, sf_dir).where("frame in (2, 10)").groupBy(*s.SERIES).agg(at(2).alias("a"), at(10).alias("b"))
    return g.where("a is not null and b is not null").select(*s.SERIES, (F.col("b") - F.col("a")).alias("delta"))


@query("e17_delta_sum", f"WITH {PF}, r(a, z) AS (VALUES (2, 10), (15, 30)) SELECT p.match_id, CAST(p.slot AS INTEGER) AS slot, CAST(sum(q.ult_charge - p.ult_charge) AS BIGINT) AS delta FROM pf p JOIN r ON p.frame = r.a JOIN pf q ON q.match_id = p.match_id AND q.slot = p.slot AND q.frame = r.z GROUP BY p.match_id, p.slot")
def e17(spark, sf_dir):
    p = pf(spark, sf_dir).where("frame in (2, 10, 15, 30)")
    part = F.when(F.col("frame").isin(2, 10), 0).otherwise(1)
    g = p.groupBy(*s.SERIES, part.alias("part")).agg(F.min_by("ult_charge", "frame").alias("a"), F.max_by("ult_charge", "frame").alias("b"), F.count("*").alias("n"))
    return g.where("n = 2").groupBy(*s.SERIES).agg(F.sum(F.col("b") - F.col("a")).alias("delta"))


@query("e13_duration", f"WITH {PF} SELECT match_id, arg_max(time, frame) AS duration FROM pf GROUP BY match_id")
def e13(spark, sf_dir):
    return pf(spark, sf_dir).groupBy("match_id").agg(F.max_by("time", "frame").alias("duration"))


@query("e18_reductions", f"WITH {PF} SELECT match_id, min(ult_charge) AS low, max(ult_charge) AS high, round(avg(ult_charge), 6) AS mean, round(stddev_pop(ult_charge), 6) AS std, quantile_cont(ult_charge, 0.9) AS p90 FROM pf GROUP BY match_id")
def e18(spark, sf_dir):
    c = F.col("ult_charge")
    return pf(spark, sf_dir).groupBy("match_id").agg(F.min(c).alias("low"), F.max(c).alias("high"), rounded(F.avg(c), 6).alias("mean"), rounded(F.stddev_pop(c), 6).alias("std"), F.percentile(c, F.lit(0.9)).alias("p90"))


WIDE = ", ".join(f"max(ult_charge) FILTER (slot = {i}) AS ults_{i}" for i in range(12))


@query("b8_wide_state", f"WITH {PF} SELECT {KF}, {WIDE} FROM pf GROUP BY match_id, frame")
def b8(spark, sf_dir):
    wide = pf(spark, sf_dir).groupBy("match_id", "frame").pivot("slot", list(range(12))).agg(F.max("ult_charge"))
    return wide.select("match_id", "frame", *(F.col(str(i)).alias(f"ults_{i}") for i in range(12)))


@query("b9_state_arrays", f"WITH {PF} SELECT {KF}, string_agg(slot || ':' || hero || ':' || CASE WHEN is_dead THEN 0 ELSE 100 END || ':' || ult_charge, ',' ORDER BY slot) AS players FROM pf GROUP BY match_id, frame")
def b9(spark, sf_dir):
    g = pf(spark, sf_dir).groupBy("match_id", "frame").agg(F.sort_array(F.collect_list(F.struct("slot", "hero", F.when(F.col("is_dead"), 0).otherwise(100).alias("hps"), "ult_charge"))).alias("p"))
    return g.select("match_id", "frame", F.array_join(F.transform("p", lambda x: F.concat_ws(":", *(x[c].cast("string") for c in ("slot", "hero", "hps", "ult_charge")))), ",").alias("players"))


@query("b6_lineups", f"""WITH {PF}, x AS (SELECT match_id, slot, arg_min(hero, frame) AS a, arg_max(hero, frame) AS z FROM pf GROUP BY ALL)
SELECT match_id, CASE WHEN slot < 6 THEN 'away' ELSE 'home' END AS team_status, string_agg(lpad((slot + 1)::VARCHAR, 2, '0') || ' ' || a || '>' || z, ';' ORDER BY slot) AS players FROM x GROUP BY ALL""")
def b6(spark, sf_dir):
    x = pf(spark, sf_dir).groupBy(*s.SERIES).agg(F.min_by("hero", "frame").alias("a"), F.max_by("hero", "frame").alias("z"))
    g = x.groupBy("match_id", F.when(F.col("slot") < 6, "away").otherwise("home").alias("team_status")).agg(F.sort_array(F.collect_list(F.struct("slot", "a", "z"))).alias("p"))
    return g.select("match_id", "team_status", F.array_join(F.transform("p", lambda x: F.format_string("%02d %s>%s", x["slot"] + 1, x["a"], x["z"])), ";").alias("players"))


@query("g3_topk", f"WITH {PF} SELECT match_id, CASE WHEN slot < 6 THEN 0 ELSE 1 END AS side, CAST(slot AS INTEGER) AS slot FROM pf WHERE frame = 3 QUALIFY row_number() OVER (PARTITION BY match_id, CASE WHEN slot < 6 THEN 0 ELSE 1 END ORDER BY ult_charge DESC, slot) <= 2")
def g3(spark, sf_dir):
    x = pf(spark, sf_dir).where("frame = 3").withColumn("side", F.when(F.col("slot") < 6, 0).otherwise(1))
    w = Window.partitionBy("match_id", "side").orderBy(F.desc("ult_charge"), "slot")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 2").select("match_id", "side", "slot")


@query("f21_prefix_gap", f"""WITH {PF}, x AS (SELECT *, coalesce(abs(ult_charge - lag(ult_charge) OVER w) > 60, false) AS g FROM pf {W}),
y AS (SELECT *, max(g) OVER (PARTITION BY match_id, slot ORDER BY frame) AS seen FROM x) SELECT {KEY} FROM y WHERE NOT seen""")
def f21(spark, sf_dir):
    x = pf(spark, sf_dir).withColumn("g", F.coalesce(F.abs(F.col("ult_charge") - F.lag("ult_charge").over(s.series())) > 60, F.lit(False)))
    return x.withColumn("seen", F.max("g").over(s.upto())).where("not seen").select(*s.SERIES, "frame")


@query("f23_interval_merge", f"""WITH {PF}, i AS (SELECT match_id, slot, frame AS a, frame + ult_charge // 30 AS z FROM pf WHERE ult_charge > 40),
n AS (SELECT *, max(z) OVER (PARTITION BY match_id, slot ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM i),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, slot ORDER BY a, z) AS g FROM n)
SELECT match_id, CAST(slot AS INTEGER) AS slot, CAST(min(a) AS INTEGER) AS first, CAST(max(z) AS INTEGER) AS last FROM g GROUP BY match_id, slot, g""")
def f23(spark, sf_dir):
    from ordwell.operators.matching import merge_intervals

    i = pf(spark, sf_dir).where("ult_charge > 40").select(*s.SERIES, F.col("frame").alias("first"), F.expr("cast(frame + ult_charge div 30 as int)").alias("last"))
    return merge_intervals(i, list(s.SERIES), "first", "last")


@query("f25_gap_scan", f"""WITH {PF}, x AS (SELECT *, lag(ult_charge, 3) OVER w AS l, lead(ult_charge, 3) OVER w AS r FROM pf {W})
SELECT match_id, CAST(slot AS INTEGER) AS slot, CAST(max(frame) FILTER (l - ult_charge > 20 AND r - ult_charge > 20) AS INTEGER) AS gap FROM x GROUP BY match_id, slot""")
def f25(spark, sf_dir):
    w, c = s.series(), F.col("ult_charge")
    x = pf(spark, sf_dir).withColumn("hit", (F.lag(c, 3).over(w) - c > 20) & (F.lead(c, 3).over(w) - c > 20))
    return x.groupBy(*s.SERIES).agg(F.max(F.when(F.col("hit"), F.col("frame"))).alias("gap"))


@query("f26_edge_validation", f"""WITH {PF}, x AS (SELECT *, max(ult_charge) OVER (PARTITION BY match_id, slot ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a,
  max(ult_charge) OVER (PARTITION BY match_id, slot ORDER BY frame ROWS BETWEEN 3 FOLLOWING AND 6 FOLLOWING) AS b FROM pf) SELECT {KEY} FROM x WHERE a >= 80 AND b >= 80""")
def f26(spark, sf_dir):
    w = s.series()
    x = pf(spark, sf_dir).withColumn("a", F.max("ult_charge").over(w.rowsBetween(-2, 1))).withColumn("b", F.max("ult_charge").over(w.rowsBetween(3, 6)))
    return x.where("a >= 80 and b >= 80").select(*s.SERIES, "frame")


@query("f27_spanned_edges", f"""WITH {PF}, x AS (SELECT *, coalesce(lag(ult_charge) OVER w, last_value(ult_charge) OVER (PARTITION BY match_id, slot ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS p FROM pf {W}) SELECT {KEY}, ult_charge + p AS spanned FROM x""")
def f27(spark, sf_dir):
    around = Window.partitionBy(*s.SERIES)
    p = F.coalesce(F.lag("ult_charge").over(s.series()), F.max_by("ult_charge", "frame").over(around))
    return pf(spark, sf_dir).select(*s.SERIES, "frame", (F.col("ult_charge") + p).alias("spanned"))


@query("f30_early_stop", f"""WITH {PF}, x AS (SELECT *, min(CASE WHEN ult_charge > 90 THEN frame END) OVER (PARTITION BY match_id, slot) AS stop FROM pf) SELECT {KEY} FROM x WHERE stop IS NULL OR frame < stop""")
def f30(spark, sf_dir):
    stop = F.min(F.when(F.col("ult_charge") > 90, F.col("frame"))).over(Window.partitionBy(*s.SERIES))
    return pf(spark, sf_dir).withColumn("stop", stop).where("stop is null or frame < stop").select(*s.SERIES, "frame")


@query("k32_first_valid_version", f"WITH {PF} SELECT match_id, CAST(min(slot) FILTER (ult_charge > 50) AS INTEGER) AS version FROM pf WHERE frame = 0 GROUP BY match_id")
def k32(spark, sf_dir):
    return pf(spark, sf_dir).where("frame = 0").groupBy("match_id").agg(F.min(F.when(F.col("ult_charge") > 50, F.col("slot"))).alias("version"))


def played(spark, sf_dir):
    """A match's three input tables: states and frames from lineitem, kills from events."""
    from ordwell.session import table

    e = table(spark, sf_dir, "events")
    team = (F.col("user_id") % 2).cast("int")
    k = e.select(
        F.expr("user_id div 30 + 1").alias("match_id"), F.expr("cast(event_id % 40 as int)").alias("frame"), F.col("event_id").cast("int").alias("row"), (1 - team).alias("killer_team"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"))).alias("killer"), team.alias("victim_team"),
        F.when(F.col("event_id") % 11 == 0, "meka").otherwise(F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string"))).alias("victim"), (F.col("event_type") == "signup").alias("is_res"),
    )
    return game.Game(pf(spark, sf_dir), frames(spark, sf_dir), k, game.Rules(mech_hero="h0"), table(spark, sf_dir, "lineitem").count())


@query("b2_archives", f"WITH {PF} SELECT match_id, CAST(slot AS INTEGER) AS slot, arg_min(hero, frame) AS starting, arg_max(hero, frame) AS final, arg_max(ult_charge, frame) || '%' AS charge FROM pf GROUP BY match_id, slot")
def b2(spark, sf_dir):
    """Line-ups written as an archive for each match and read back."""
    import uuid

    from ordwell.session import shared_folder
    from ordwell.sources import archives, files

    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives.write_archives(archives.rows_of(game.lineups(pf(spark, sf_dir)), "data_sheet2", "slot"), path)
    rows = F.explode(F.from_json("json", "array<struct<slot: int, starting: string, final: string, charge: string>>")).alias("r")
    match = F.regexp_extract("path", r"([^/]+)\.zip$", 1).cast("long")
    return files.read_archives(spark, path).where("document = 'data_sheet2'").select(match.alias("match_id"), rows).select("match_id", "r.*")


@query("mu7_pipeline")
def mu7(spark, sf_dir):
    return played(spark, sf_dir).analyse()["timeline"]


@query("mu7_states")
def mu7_states(spark, sf_dir):
    return played(spark, sf_dir).analyse()["player_frames"]


@query("j17_created_at", "SELECT n_nationkey, true AS well_formed FROM nation")
def j17(spark, sf_dir):
    from ordwell.functions import text
    from ordwell.session import table

    return table(spark, sf_dir, "nation").select("n_nationkey", text.created_at().rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$").alias("well_formed"))

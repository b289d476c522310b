"""The engine's normal tables, read from match data or made from the driver's tables.

Each adapter has a Spark form and, for the oracles, the same as a DuckDB CTE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordwell.session import dealt, table

START = 1704067200
WINDOW = 3


def player(team, hero):
    return F.struct(team.cast("int").alias("team"), hero.alias("hero"))


def name(prefix: str, number):
    return F.concat(F.lit(prefix), number.cast("string"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kill-feed detections from events: match_id, frame, row, player1, player2, assists, ability, is_critical, is_environmental."""
    w = Window.partitionBy("match_id", "frame").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return dealt(as_detections(e), e.count(), "match_id", "frame").withColumn("row", (F.row_number().over(w) - 1).cast("int")).drop("ts")


def as_detections(events: DataFrame) -> DataFrame:
    """events, a table or a stream, as detections with ts and without row."""
    e = events.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    team = F.expr("cast(pmod(user_id div 15, 2) as int)")
    resurrects = F.col("event_type") == "signup"
    mate = F.when(resurrects, team).otherwise(1 - team)
    killer = F.when(F.col("event_type") != "error", player(mate, name("h", F.col("event_id") % 4)))
    return e.select(
        F.expr("user_id div 30").alias("match_id"),
        F.expr(f"cast((unix_seconds(cast(ts as timestamp)) - {START}) div 3600 as int)").alias("frame"),
        "ts",
        "event_id",
        killer.alias("player1"),
        player(team, name("v", F.expr("pmod(user_id div 5, 3)"))).alias("player2"),
        F.array(player(mate, name("h", F.col("k") % 4))).alias("assists"),
        F.when(F.col("event_type") != "view", F.struct(F.lit("ability").alias("category"), name("a", F.col("k") % 3).alias("name"))).alias("ability"),
        (F.col("value") > 100).alias("is_critical"),
        (F.col("event_id") % 7 == 0).alias("is_environmental"),
    )


DET = f"""det0 AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    (user_id // 15) % 2 AS vt FROM events),
det AS (
  SELECT event_id, user_id // 30 AS match_id, (epoch_us(ts) // 1000000 - {START}) // 3600 AS frame,
    row_number() OVER (PARTITION BY user_id // 30, (epoch_us(ts) // 1000000 - {START}) // 3600 ORDER BY ts, event_id) - 1 AS row,
    CASE WHEN event_type <> 'error' THEN CASE WHEN event_type = 'signup' THEN vt ELSE 1 - vt END END AS kt,
    CASE WHEN event_type <> 'error' THEN 'h' || (event_id % 4) END AS kh,
    vt, 'v' || ((user_id // 5) % 3) AS vh, coalesce(event_type = 'signup', false) AS is_res,
    CASE WHEN event_type = 'signup' THEN vt ELSE 1 - vt END AS asst, 'h' || (k % 4) AS ah,
    CASE WHEN event_type <> 'view' THEN 'a' || (k % 3) END AS ability, value > 100 AS is_critical, event_id % 7 = 0 AS is_environmental
  FROM det0)"""


def player_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each slot in each frame, from lineitem."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    w = Window.partitionBy("match_id", "slot").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    p = l.select(F.col("l_suppkey").alias("match_id"), (F.col("l_partkey") % 12).cast("int").alias("slot"), "*")
    p = dealt(p, l.count(), "match_id")
    charge = (F.col("l_quantity") * 2).cast("int")
    return p.withColumn("frame", (F.row_number().over(w) - 1).cast("int")).select(
        "match_id",
        "slot",
        "frame",
        (F.col("frame") * 0.5).cast("double").alias("time"),
        name("h", F.col("l_linenumber") % 3).alias("hero"),
        (F.col("l_returnflag") == "A").alias("is_dead"),
        charge.alias("ult_charge"),
        (charge >= 95).alias("is_ult_ready"),
    )


PF = """pf AS (
  SELECT l_suppkey AS match_id, l_partkey % 12 AS slot,
    row_number() OVER (PARTITION BY l_suppkey, l_partkey % 12 ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS frame,
    (row_number() OVER (PARTITION BY l_suppkey, l_partkey % 12 ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1) * CAST(0.5 AS DOUBLE) AS time,
    'h' || (l_linenumber % 3) AS hero, l_returnflag = 'A' AS is_dead, CAST(l_quantity * 2 AS INTEGER) AS ult_charge,
    CAST(l_quantity * 2 AS INTEGER) >= 95 AS is_ult_ready
  FROM lineitem)"""

#: The driver's event types as actions.
ACTIONS = {"click": "Eliminate", "purchase": "Eliminate", "signup": "Resurrect", "error": "Suicide", "view": "Demech"}
GAP = 1800.0


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match events: match_id, event_id, time_s, action, subject and object slots."""
    actions = F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair))
    return table(spark, sf_dir, "events").select(
        F.expr("user_id div 144").alias("match_id"),
        "event_id",
        F.expr(f"(unix_micros(cast(ts as timestamp)) - {START}000000) / 1000000D").alias("time_s"),
        actions[F.col("event_type")].alias("action"),
        F.expr("cast(user_id % 12 as int)").alias("subject"),
        F.expr("cast((user_id div 12) % 12 as int)").alias("object"),
    )


TL = f"""tl AS (
  SELECT user_id // 144 AS match_id, event_id, (epoch_us(ts) - {START}000000) / CAST(1000000 AS DOUBLE) AS time_s,
    CASE event_type WHEN 'click' THEN 'Eliminate' WHEN 'purchase' THEN 'Eliminate' WHEN 'signup' THEN 'Resurrect' WHEN 'error' THEN 'Suicide' WHEN 'view' THEN 'Demech' END AS action,
    user_id % 12 AS subject, (user_id // 12) % 12 AS object
  FROM events)"""

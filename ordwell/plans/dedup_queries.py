"""Queries of de-duplication, with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ordwell.operators import dedup as d
from ordwell.plans.registry import query
from ordwell.session import table
from ordwell.sources.adapters import DET, WINDOW, detections

CLUSTER = f"""{DET},
rs AS (
  SELECT match_id, kt, kh, vt, vh, frame, row,
    CASE WHEN lag(frame) OVER w IS NULL OR frame - lag(frame) OVER w > {WINDOW} THEN 1 ELSE 0 END AS new
  FROM det WHERE is_res WINDOW w AS (PARTITION BY match_id, kt, kh, vt, vh ORDER BY frame, row)),
rr AS (
  SELECT match_id, kt, kh, vt, vh, min(frame) AS first, max(frame) AS last
  FROM (SELECT *, sum(new) OVER (PARTITION BY match_id, kt, kh, vt, vh ORDER BY frame, row) AS g FROM rs) GROUP BY match_id, kt, kh, vt, vh, g),
pr AS (
  SELECT *, CASE WHEN is_res THEN kh END AS rescuer,
    lag(frame) OVER (PARTITION BY match_id, vt, vh, is_res, CASE WHEN is_res THEN kh END ORDER BY frame, row) AS prev FROM det),
br AS (
  SELECT *, CASE WHEN prev IS NULL OR frame - prev > {WINDOW} OR EXISTS (
      SELECT 1 FROM rr WHERE rr.match_id = pr.match_id AND rr.vt = pr.vt AND rr.vh = pr.vh AND pr.prev < rr.first AND rr.last < pr.frame)
    THEN 1 ELSE 0 END AS new FROM pr),
cl AS (
  SELECT *, sum(new) OVER (PARTITION BY match_id, vt, vh, is_res, rescuer ORDER BY frame, row) AS cluster FROM br)"""
BY = "match_id, vt, vh, is_res, rescuer, cluster"


def flat(df):
    """The key's structs as plain columns."""
    return df.select("*", F.col("player2.team").alias("vt"), F.col("player2.hero").alias("vh"), F.col("rescuer.hero").alias("rescuer_hero"))


def clustered(spark, sf_dir):
    return d.clusters(detections(spark, sf_dir), WINDOW, table(spark, sf_dir, "events").count())


def rows(spark, sf_dir):
    return d.match_key(detections(spark, sf_dir))


@query("f1_islands_dedup", f"WITH {CLUSTER} SELECT event_id, CAST(cluster AS BIGINT) AS cluster FROM cl")
def f1(spark, sf_dir):
    return clustered(spark, sf_dir).select("event_id", F.col("cluster").cast("long").alias("cluster"))


VOTES = """
vote AS (SELECT {by}, kt, kh, count(*) AS n, min(frame * 1000 + row) AS pos FROM {rows} WHERE kh IS NOT NULL GROUP BY ALL),
best AS (SELECT {by}, kt, kh, n FROM vote QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY n DESC, pos) = 1),
avote AS (SELECT {by}, ability, count(*) AS n, min(frame * 1000 + row) AS pos FROM {rows} WHERE ability IS NOT NULL GROUP BY ALL),
abest AS (SELECT {by}, ability, n FROM avote QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY n DESC, pos) = 1),
size AS (
  SELECT {by}, count(*) AS n, min(frame * 1000 + row) AS anchor, sum(is_critical::INT) AS crit, sum(is_environmental::INT) AS env FROM {rows} GROUP BY ALL),
ahero AS (SELECT {by}, ah, count(*) AS n, min(frame * 1000 + row) AS pos FROM {rows} GROUP BY ALL),
ateam AS (SELECT {by}, ah, asst, count(*) AS n, min(frame * 1000 + row) AS pos FROM {rows} GROUP BY ALL),
atop AS (SELECT {by}, ah, asst FROM ateam QUALIFY row_number() OVER (PARTITION BY {by}, ah ORDER BY n DESC, pos) = 1)"""
EVENTS = """SELECT {out}, CAST(s.anchor // 1000 AS INTEGER) AS frame, CAST(s.anchor % 1000 AS INTEGER) AS row, CAST(s.n AS INTEGER) AS n,
  CAST(b.kt AS INTEGER) AS killer_team, b.kh AS killer_hero, CASE WHEN 2 * a.n > s.n THEN a.ability END AS ability,
  2 * s.crit > s.n AS is_critical, 2 * s.env > s.n AS is_environmental,
  coalesce((SELECT string_agg(h.ah || ':' || t.asst, ',' ORDER BY h.pos) FROM ahero h JOIN atop t ON {ht} AND h.ah = t.ah WHERE {hs} AND 2 * h.n > s.n), '') AS assists
FROM size s LEFT JOIN best b ON {bs} LEFT JOIN abest a ON {as_}"""


def same(a: str, b: str, by: str = BY) -> str:
    """SQL: rows a and b are of one group."""
    return " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in by.split(", "))


def events_sql(rows: str, by: str, out: str) -> str:
    """SQL that merges the rows of each group into an event, after its common tables."""
    return f"{VOTES.format(by=by, rows=rows)} {EVENTS.format(out=out, ht=same('h', 't', by), hs=same('h', 's', by), bs=same('b', 's', by), as_=same('a', 's', by))}"


OF_CLUSTERS = VOTES.format(by=BY, rows="cl")
SAME_ = {a: same(a, "s") for a in "bath"}


def merged(spark, sf_dir):
    return d.merge(clustered(spark, sf_dir), [*d.KEY, "cluster"])


def shown(df, *more):
    return flat(df).select("match_id", "vt", "vh", "is_res", F.col("rescuer_hero").alias("rescuer"), F.col("cluster").cast("long").alias("cluster"), *more)


OUT = "s.match_id, CAST(s.vt AS INTEGER) AS vt, s.vh, s.is_res, s.rescuer, CAST(s.cluster AS BIGINT) AS cluster"


def events(df):
    """What merge() gives, flat; the group's other columns follow."""
    assists = F.array_join(F.transform("assists", lambda a: F.concat_ws(":", a["hero"], a["team"].cast("string"))), ",")
    return shown(
        df, "frame", "row", "n", F.col("player1.team").alias("killer_team"), F.col("player1.hero").alias("killer_hero"),
        F.col("ability.name").alias("ability"), "is_critical", "is_environmental", assists.alias("assists"),
        *(["piece"] if "piece" in df.columns else []),
    )


@query("e1_cluster_merge", f"WITH {CLUSTER}, {events_sql('cl', BY, OUT)}")
def e1(spark, sf_dir):
    return events(merged(spark, sf_dir))


@query("e2_anchor", f"WITH {CLUSTER}, {OF_CLUSTERS} SELECT {OUT}, CAST(s.anchor // 1000 AS INTEGER) AS frame, CAST(s.anchor % 1000 AS INTEGER) AS row FROM size s")
def e2(spark, sf_dir):
    c = clustered(spark, sf_dir).groupBy(*d.KEY, "cluster").agg(F.min(F.struct("frame", "row")).alias("a"))
    return shown(c, "a.frame", "a.row")


@query("e3_plurality", f"WITH {CLUSTER}, {OF_CLUSTERS} SELECT {OUT}, CAST(b.kt AS INTEGER) AS killer_team, b.kh AS killer_hero FROM size s LEFT JOIN best b ON {SAME_['b']}")
def e3(spark, sf_dir):
    return shown(merged(spark, sf_dir), F.col("player1.team").alias("killer_team"), F.col("player1.hero").alias("killer_hero"))


@query("e4_majority", f"WITH {CLUSTER}, {OF_CLUSTERS} SELECT {OUT}, CASE WHEN 2 * a.n > s.n THEN a.ability END AS ability FROM size s LEFT JOIN abest a ON {SAME_['a']}")
def e4(spark, sf_dir):
    return shown(merged(spark, sf_dir), F.col("ability.name").alias("ability"))


@query("e5_bool_majority", f"WITH {CLUSTER}, {OF_CLUSTERS} SELECT {OUT}, 2 * s.crit > s.n AS is_critical, 2 * s.env > s.n AS is_environmental FROM size s")
def e5(spark, sf_dir):
    half = lambda c: (F.sum(F.col(c).cast("int")) * 2 > F.count("*")).alias(c)
    return shown(clustered(spark, sf_dir).groupBy(*d.KEY, "cluster").agg(half("is_critical"), half("is_environmental")), "is_critical", "is_environmental")


@query("e6_assists", f"WITH {CLUSTER}, {OF_CLUSTERS} SELECT {OUT}, h.ah AS hero, CAST(t.asst AS INTEGER) AS team FROM size s JOIN ahero h ON {SAME_['h']} AND 2 * h.n > s.n JOIN atop t ON {SAME_['t']} AND t.ah = h.ah")
def e6(spark, sf_dir):
    return shown(merged(spark, sf_dir).withColumn("a", F.explode("assists")), "a.hero", "a.team")


@query("e7_res_ranges", f"WITH {CLUSTER} SELECT match_id, CAST(kt AS INTEGER) AS kt, kh, vh, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM rr")
def e7(spark, sf_dir):
    r = d.resurrection_ranges(detections(spark, sf_dir), WINDOW)
    return r.select("match_id", F.col("player1.team").alias("kt"), F.col("player1.hero").alias("kh"), F.col("player2.hero").alias("vh"), "first", "last")


@query("e8_group_lists", f"WITH {DET} SELECT match_id, vh, string_agg(event_id::VARCHAR, ',' ORDER BY frame, row) AS events FROM det GROUP BY match_id, vh")
def e8(spark, sf_dir):
    g = detections(spark, sf_dir).groupBy("match_id", F.col("player2.hero").alias("vh")).agg(F.sort_array(F.collect_list(F.struct("frame", "row", "event_id"))).alias("l"))
    return g.select("match_id", "vh", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("events"))


@query("e24_cluster_size", f"WITH {CLUSTER} SELECT event_id, count(*) OVER (PARTITION BY {BY}) AS n FROM cl")
def e24(spark, sf_dir):
    return clustered(spark, sf_dir).select("event_id", F.count("*").over(Window.partitionBy(*d.KEY, "cluster")).alias("n"))


SPLIT = f"""WITH RECURSIVE {CLUSTER},
rec AS (
  SELECT 0 AS it, {BY}, event_id, frame, row, CAST(NULL AS BIGINT) AS piece FROM cl
  UNION ALL
  SELECT it + 1, {BY}, event_id, frame, row, CASE WHEN frame >= twice AND row <= low THEN CASE WHEN row = low THEN it + 1 ELSE -1 END END
  FROM (SELECT *, min(CASE WHEN frame = twice THEN row END) OVER (PARTITION BY {BY}) AS low
    FROM (SELECT *, min(CASE WHEN often > 1 THEN frame END) OVER (PARTITION BY {BY}) AS twice
      FROM (SELECT *, count(*) OVER (PARTITION BY {BY}, frame) AS often FROM rec WHERE piece IS NULL)))
  WHERE twice IS NOT NULL),
last AS (SELECT *, max(it) OVER (PARTITION BY {BY}) AS stop FROM rec),
pieces AS (SELECT event_id, CAST(coalesce(piece, 0) AS INTEGER) AS piece FROM last WHERE piece >= 0 OR piece IS NULL AND it = stop)"""


@query("f3_row_split", f"{SPLIT} SELECT event_id, piece FROM pieces")
def f3(spark, sf_dir):
    return d.split_clusters(clustered(spark, sf_dir)).select("event_id", "piece")


def whole_sql(det: str = DET) -> str:
    """SQL of the distinct events behind the detections that the tables det end in."""
    return f"{SPLIT.replace(DET, det)}, pc AS (SELECT cl.*, p.piece FROM cl JOIN pieces p USING (event_id)), {events_sql('pc', f'{BY}, piece', f'{OUT}, s.piece')}"


@query("mu6_deduplicate", whole_sql())
def mu6(spark, sf_dir):
    return events(d.Detections(detections(spark, sf_dir), WINDOW, table(spark, sf_dir, "events").count()).deduplicate())


@query("f19_res_bursts", f"WITH {CLUSTER} SELECT match_id, vh, count(*) AS bursts FROM rr GROUP BY match_id, vh")
def f19(spark, sf_dir):
    return d.resurrection_ranges(detections(spark, sf_dir), WINDOW).groupBy("match_id", F.col("player2.hero").alias("vh")).agg(F.count("*").alias("bursts"))


@query("dj6_barrier_anti", f"WITH {CLUSTER} SELECT event_id, prev IS NOT NULL AND EXISTS (SELECT 1 FROM rr WHERE rr.match_id = pr.match_id AND rr.vt = pr.vt AND rr.vh = pr.vh AND pr.prev < rr.first AND rr.last < pr.frame) AS blocked FROM pr")
def dj6(spark, sf_dir):
    w = Window.partitionBy(*d.KEY).orderBy("frame", "row")
    keyed = rows(spark, sf_dir).withColumn("prev", F.lag("frame").over(w))
    return d.barriers(keyed, d.resurrection_ranges(detections(spark, sf_dir), WINDOW)).select("event_id", "blocked")


@query("dj7_band_islands", f"WITH {DET}, x AS (SELECT *, lag(frame) OVER (PARTITION BY match_id, vt, vh ORDER BY frame, row) AS p FROM det) SELECT match_id, vh, count(*) FILTER (p IS NULL OR frame - p > {WINDOW}) AS islands FROM x GROUP BY match_id, vh")
def dj7(spark, sf_dir):
    w = Window.partitionBy("match_id", "player2").orderBy("frame", "row")
    x = detections(spark, sf_dir).withColumn("p", F.lag("frame").over(w)).withColumn("vh", F.col("player2.hero"))
    return x.groupBy("match_id", "vh").agg(F.count(F.when(F.col("p").isNull() | (F.col("frame") - F.col("p") > WINDOW), 1)).alias("islands"))


@query("c9_pair_equality", f"WITH {DET} SELECT event_id, lag(vh) OVER w IS NOT DISTINCT FROM vh AND lag(vt) OVER w IS NOT DISTINCT FROM vt AND lag(kh) OVER w IS NOT DISTINCT FROM kh AND lag(kt) OVER w IS NOT DISTINCT FROM kt AS same FROM det WINDOW w AS (PARTITION BY match_id ORDER BY frame, row)")
def c9(spark, sf_dir):
    w = Window.partitionBy("match_id").orderBy("frame", "row")
    same = F.lag("player2").over(w).eqNullSafe(F.col("player2")) & F.lag("player1").over(w).eqNullSafe(F.col("player1"))
    return detections(spark, sf_dir).select("event_id", same.alias("same"))


@query("c10_match_key", f"WITH {DET} SELECT match_id, vh, is_res, CASE WHEN is_res THEN kh END AS rescuer, count(*) AS n FROM det GROUP BY ALL")
def c10(spark, sf_dir):
    return rows(spark, sf_dir).groupBy("match_id", F.col("player2.hero").alias("vh"), "is_res", F.col("rescuer.hero").alias("rescuer")).agg(F.count("*").alias("n"))


@query("c8_neighbour_dup", f"""WITH {DET},
ff AS (SELECT match_id, frame, arg_min((kt, kh, vt, vh), row) AS first, arg_max((kt, kh, vt, vh), row) AS last, arg_min(event_id, row) AS event_id FROM det GROUP BY match_id, frame)
SELECT event_id FROM (SELECT *, lag(last) OVER w AS before, lag(frame) OVER w AS bf FROM ff WINDOW w AS (PARTITION BY match_id ORDER BY frame)) WHERE bf = frame - 1 AND first IS NOT DISTINCT FROM before""")
def c8(spark, sf_dir):
    pair = F.struct("player1", "player2")
    ff = detections(spark, sf_dir).groupBy("match_id", "frame").agg(F.min_by(pair, "row").alias("first"), F.max_by(pair, "row").alias("last"), F.min_by("event_id", "row").alias("event_id"))
    w = Window.partitionBy("match_id").orderBy("frame")
    return ff.where(F.lit(True)).withColumn("before", F.lag("last").over(w)).withColumn("bf", F.lag("frame").over(w)).where("bf = frame - 1 and first <=> before").select("event_id")


@query("j33_is_resurrection", f"WITH {DET} SELECT event_id, is_res FROM det")
def j33(spark, sf_dir):
    return rows(spark, sf_dir).select("event_id", "is_res")


@query("g1_entry_order", f"WITH {DET} SELECT event_id, row_number() OVER (PARTITION BY match_id ORDER BY frame, row) AS place FROM det")
def g1(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("match_id").orderBy("frame", "row")).cast("long").alias("place"))


@query("g5_row_limit", f"WITH {DET} SELECT event_id FROM det WHERE row < 6")
def g5(spark, sf_dir):
    return detections(spark, sf_dir).where("row < 6").select("event_id")


@query("b12_rendering", f"WITH {DET} SELECT event_id, concat_ws(' ', '[' || frame || ':' || row || ']', coalesce(kh, '-'), CASE WHEN is_res THEN '+>' ELSE '->' END, vh, CASE WHEN is_critical THEN '*' END, CASE WHEN is_environmental THEN '~' END) AS line FROM det")
def b12(spark, sf_dir):
    spot = F.format_string("[%d:%d]", "frame", "row")
    line = F.concat_ws(" ", spot, F.coalesce("player1.hero", F.lit("-")), F.when(F.col("is_res"), "+>").otherwise("->"), "player2.hero", F.when(F.col("is_critical"), "*"), F.when(F.col("is_environmental"), "~"))
    return rows(spark, sf_dir).select("event_id", line.alias("line"))


@query("b11_serialise", f"WITH {DET} SELECT event_id, '{{\"frame\":' || frame || ',\"row\":' || row || ',\"player2\":{{\"team\":' || vt || ',\"hero\":\"' || vh || '\"}},\"is_critical\":' || is_critical || '}}' AS json FROM det")
def b11(spark, sf_dir):
    return detections(spark, sf_dir).select("event_id", F.to_json(F.struct("frame", "row", "player2", "is_critical")).alias("json"))

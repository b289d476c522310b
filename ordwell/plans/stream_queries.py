"""Streams over the events table, drained into tables, with their oracles."""

import uuid

from pyspark.sql import functions as F

from ordwell.plans.dedup_queries import events as shown_events
from ordwell.plans.dedup_queries import whole_sql
from ordwell.plans.registry import query
from ordwell.session import shared_folder, table
from ordwell.sources.adapters import DET, WINDOW, as_detections
from ordwell.streaming import batches, folds, sessions
from ordwell.streaming.events import deduplicated

MINUTE = 60
GAP = 120
DELAY = 3600


def raw_events(spark, sf_dir):
    """The events as a stream, a bounded number of files for each batch."""
    shape = table(spark, sf_dir, "events").schema
    return sessions.stream_table(spark, f"{sf_dir}/event[s].parquet", shape)  # a pattern, as a path must be a folder


def events(spark, sf_dir):
    """The events as a stream; a frame is a minute."""
    stream = raw_events(spark, sf_dir)
    return stream.select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


@query("l1_append_stream", "SELECT event_id, event_type FROM events")
def l1(spark, sf_dir):
    return sessions.drained(events(spark, sf_dir).select("event_id", "event_type"))


# runs of a user's events with gaps of at most GAP minutes, as far as the last watermark closed them
@query("l2_stream_dedup", f"""WITH e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) // {MINUTE}000000 AS frame, epoch_us(ts) // 1000 AS ms FROM events),
g AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= {GAP} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY key ORDER BY frame, ms)),
r AS (SELECT key, frame, ms, sum(new) OVER (PARTITION BY key ORDER BY frame, ms) AS run FROM g)
SELECT key, min(frame) AS first, max(frame) AS last, count(*) AS n FROM r GROUP BY key, run HAVING max(ms) + {(GAP + 1) * MINUTE}000 < (SELECT max(ms) FROM e) - {DELAY}000""")
def l2(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("frame", F.expr(f"unix_seconds(ts) div {MINUTE}"))
    return sessions.drained(sessions.dedup_stream(e, GAP, watermark=f"{DELAY} seconds", frame_ms=MINUTE * 1000))


@query("l5_stream_windows", f"""WITH e AS (SELECT epoch_us(ts) // 3600000000 AS h FROM events), m AS (SELECT max(epoch_us(ts)) - {DELAY}000000 AS mark FROM events)
SELECT h * 3600 AS start, count(*) AS n FROM e, m WHERE (h + 1) * 3600000000 <= mark GROUP BY h""")
def l5(spark, sf_dir):
    out = sessions.drained(sessions.windowed_counts(events(spark, sf_dir), "ts", "1 hour", None, f"{DELAY} seconds"))
    return out.select(F.unix_seconds("start").alias("start"), "n")


# detections in chains that the last watermark closed; a row's place in its frame is its event's number
HOUR_MS = 3600000
CLOSED = f"""{DET.replace("det AS (", "det1 AS (")},
det2 AS (SELECT d.* REPLACE (d.event_id AS row), epoch_us(e.ts) // 1000 AS ms FROM det1 d JOIN events e USING (event_id)),
ch AS (SELECT *, sum(begins) OVER (PARTITION BY match_id, vt, vh ORDER BY frame, row) AS chain FROM (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY match_id, vt, vh ORDER BY frame, row) <= {WINDOW} THEN 0 ELSE 1 END AS begins FROM det2)),
det AS (SELECT * EXCLUDE (begins, chain, ms) FROM ch QUALIFY max(ms) OVER (PARTITION BY match_id, vt, vh, chain) + {(WINDOW + 1) * HOUR_MS} < (SELECT max(ms) FROM det2) - {DELAY}000)"""


@query("l2_deduplicate_stream", f"SELECT * EXCLUDE cluster FROM ({whole_sql(CLOSED)})".replace("* 1000 +", "* 100000000 +").replace("// 1000 AS INTEGER", "// 100000000 AS INTEGER").replace("% 1000 AS INTEGER", "% 100000000 AS INTEGER"))
def l2_deduplicate(spark, sf_dir):
    d = as_detections(raw_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("row", F.col("event_id").cast("int"))
    found = deduplicated(d.drop("event_id"), WINDOW, watermark=f"{DELAY} seconds", frame_ms=HOUR_MS)
    return shown_events(found.withColumn("cluster", F.lit(0))).drop("cluster")


# a catalogue of hosts, grown from a stream of pages
@query("b13_catalogue_once", "SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages WHERE url IS NOT NULL")
def b13(spark, sf_dir):
    shape = table(spark, sf_dir, "pages").schema
    pages = sessions.stream_table(spark, f"{sf_dir}/page[s].parquet", shape)
    hosts = pages.select(F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host"))
    path = f"{shared_folder(spark)}/catalogue-{uuid.uuid4().hex}"
    batches.run(batches.append_new_stream(hosts, path, "host"), spark)
    return batches.written(spark, path, hosts.schema)


# an event's type, smoothed over each user's events in order, as far as the last watermark lets rows out; a series' last such row waits for the next
@query("l7_smooth_stream", f"""WITH RECURSIVE e AS (SELECT user_id AS match_id, epoch_us(ts) AS frame, event_type AS hero FROM events),
c AS (SELECT * FROM e WHERE frame // 1000 < (SELECT max(frame) // 1000 FROM e) - {DELAY}000),
n AS (SELECT *, row_number() OVER w AS i, lead(hero) OVER w AS nx FROM c WINDOW w AS (PARTITION BY match_id ORDER BY frame)),
r AS (
  SELECT match_id, frame, i, nx, hero AS hero_clean FROM n WHERE i = 1
  UNION ALL
  SELECT n.match_id, n.frame, n.i, n.nx, CASE WHEN r.hero_clean = n.nx AND n.hero <> r.hero_clean THEN r.hero_clean ELSE n.hero END FROM r JOIN n ON n.match_id = r.match_id AND n.i = r.i + 1)
SELECT match_id, frame, hero_clean FROM r WHERE nx IS NOT NULL""")
def l7(spark, sf_dir):
    e = raw_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    states = e.select(F.col("user_id").alias("match_id"), F.lit(0).alias("slot"), F.unix_micros("ts").alias("frame"), F.col("event_type").alias("hero"), "ts")
    out = folds.fold_stream(states, folds.smoothing("hero"), "hero_clean string", ["hero"], watermark=f"{DELAY} seconds")
    path = f"{shared_folder(spark)}/folds-{uuid.uuid4().hex}"
    batches.run(batches.each_batch(out, path, lambda rows, _: rows), spark)
    return batches.written(spark, path, out.schema).drop("slot")

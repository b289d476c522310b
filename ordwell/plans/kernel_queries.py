"""Queries over boxes, jobs and vectors, with oracles where SQL has them."""

from pyspark.sql import functions as F

from ordwell.functions import kernels
from ordwell.operators import spatial
from ordwell.plans.registry import query
from ordwell.session import table
from ordwell.sources.frames import Job, plan_ranges, sampled

BOX = "bx AS (SELECT label AS image, vec_id AS pos, floor(abs(embedding[1]) * 300) AS x1, floor(abs(embedding[2]) * 300) AS y1, 20 + floor(abs(embedding[3]) * 60) AS w, 20 + floor(abs(embedding[4]) * 60) AS h, round(embedding[5]::DOUBLE, 6) AS score FROM embeddings)"


def boxes(spark, sf_dir):
    e = lambda k: F.abs(F.col("embedding")[k])
    v = table(spark, sf_dir, "embeddings")
    b = v.select("vec_id", F.col("label").alias("image"), F.floor(e(0) * F.lit(300).cast("float")).alias("x1"), F.floor(e(1) * F.lit(300).cast("float")).alias("y1"), (20 + F.floor(e(2) * F.lit(60).cast("float"))).alias("w"), (20 + F.floor(e(3) * F.lit(60).cast("float"))).alias("h"), F.round(F.col("embedding")[4].cast("double"), 6).alias("score"))
    return b.select(F.col("vec_id").alias("pos"), "image", "x1", "y1", (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), "score")


SIDES = "b2 AS (SELECT image, pos, x1, y1, x1 + w AS x2, y1 + h AS y2, score FROM bx)"
RANKED = "ok AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY y1, pos) AS k FROM bx)"


@query("k7_nms", f"""WITH RECURSIVE {BOX}, {SIDES},
o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, pos) AS k FROM b2),
r AS (
  SELECT image, k, [pos] AS kept, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS boxes FROM o WHERE k = 1
  UNION ALL
  SELECT image, k, CASE WHEN gone THEN kept ELSE list_append(kept, pos) END, CASE WHEN gone THEN boxes ELSE list_append(boxes, own) END
  FROM (SELECT o.image, o.k, o.pos, r.kept, r.boxes, {{'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}} AS own,
      list_bool_or(list_transform(r.boxes, lambda b: greatest(0, least(b.x2, o.x2) - greatest(b.x1, o.x1)) * greatest(0, least(b.y2, o.y2) - greatest(b.y1, o.y1)) / ((o.x2 - o.x1) * (o.y2 - o.y1)) > 0.3)) AS gone
    FROM r JOIN o ON o.image = r.image AND o.k = r.k + 1))
SELECT image, unnest(kept) AS pos FROM (SELECT image, arg_max(kept, k) AS kept FROM r GROUP BY image)""")
def k7(spark, sf_dir):
    return spatial.suppress(boxes(spark, sf_dir), ["image"])


@query("e20_best_candidate", f"WITH {BOX} SELECT image, arg_max(pos, (round_even(score / 0.03, 0), h, pos)) AS best FROM bx GROUP BY image")
def e20(spark, sf_dir):
    best = F.max_by("pos", F.struct(F.bround(F.col("score") / 0.03, 0), F.col("y2") - F.col("y1"), "pos"))
    return boxes(spark, sf_dir).groupBy("image").agg(best.alias("best"))


@query("e21_argmax_first", f"WITH {BOX} SELECT image, arg_max(pos, (w, -pos)) AS best FROM bx GROUP BY image")
def e21(spark, sf_dir):
    return boxes(spark, sf_dir).groupBy("image").agg(F.max_by("pos", F.struct(F.col("x2") - F.col("x1"), -F.col("pos"))).alias("best"))


@query("f24_bottom_up", f"WITH {BOX} SELECT image, pos, row_number() OVER (PARTITION BY image ORDER BY y1 DESC, pos) - 1 AS row FROM bx")
def f24(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("image").orderBy(F.desc("y1"), "pos")
    return boxes(spark, sf_dir).select("image", "pos", (F.row_number().over(w) - 1).cast("long").alias("row"))


@query("g4_box_order", f"WITH {BOX} SELECT image, string_agg(pos::VARCHAR, ',' ORDER BY x1, y1, pos) AS boxes FROM bx GROUP BY image")
def g4(spark, sf_dir):
    g = boxes(spark, sf_dir).groupBy("image").agg(F.sort_array(F.collect_list(F.struct("x1", "y1", "pos"))).alias("l"))
    return g.select("image", F.array_join(F.transform("l", lambda x: x["pos"].cast("string")), ",").alias("boxes"))


@query("f20_anchor_rows", f"""WITH RECURSIVE {BOX}, {RANKED},
r AS (
  SELECT image, k, pos, y1 AS first, 0 AS group_no FROM ok WHERE k = 1
  UNION ALL
  SELECT o.image, o.k, o.pos, CASE WHEN o.y1 - r.first > 25 THEN o.y1 ELSE r.first END, r.group_no + CASE WHEN o.y1 - r.first > 25 THEN 1 ELSE 0 END
  FROM r JOIN ok o ON o.image = r.image AND o.k = r.k + 1)
SELECT image, pos, CAST(group_no AS INTEGER) AS group_no FROM r""")
def f20(spark, sf_dir):
    return spatial.group_rows(boxes(spark, sf_dir), ["image"], "y1", kernels.anchored_groups, 25.0)


@query("f22_first_fit_rows", f"""WITH RECURSIVE {BOX}, {RANKED},
r AS (
  SELECT image, k, pos, 1 AS own, [{{'c': y1::DOUBLE, 's': y1::DOUBLE, 'n': 1}}] AS rows FROM ok WHERE k = 1
  UNION ALL
  SELECT image, k, pos, CASE WHEN hit > 0 THEN hit ELSE len(rows) + 1 END,
    CASE WHEN hit > 0 THEN list_transform(rows, lambda x, i: CASE WHEN i = hit THEN {{'c': trunc((x.s + y1) / (x.n + 1)), 's': x.s + y1, 'n': x.n + 1}} ELSE x END)
      ELSE list_append(rows, {{'c': y1::DOUBLE, 's': y1::DOUBLE, 'n': 1}}) END
  FROM (SELECT o.image, o.k, o.pos, o.y1, r.rows, coalesce(list_position(list_transform(r.rows, lambda x: abs(o.y1 - x.c) <= 25), true), 0) AS hit FROM r JOIN ok o ON o.image = r.image AND o.k = r.k + 1))
SELECT image, pos, CAST(own - 1 AS INTEGER) AS group_no FROM r""")
def f22(spark, sf_dir):
    return spatial.group_rows(boxes(spark, sf_dir), ["image"], "y1", kernels.first_fit_rows, 25.0)


@query("c12_score_threshold", f"WITH {BOX} SELECT pos FROM bx WHERE score >= 0.1")
def c12(spark, sf_dir):
    return boxes(spark, sf_dir).where("score >= 0.1").select("pos")


@query("c13_blob_filter", f"WITH {BOX} SELECT pos FROM bx WHERE greatest(w, h) / least(w, h) >= 1.2 AND w * h >= 800")
def c13(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("w", F.col("x2") - F.col("x1")).withColumn("h", F.col("y2") - F.col("y1"))
    return b.where("greatest(w, h) / least(w, h) >= 1.2 and w * h >= 800").select("pos")


@query("a2_sampling", "SELECT i * 12 AS frame, i / 5.0::DOUBLE AS time FROM (SELECT unnest(range(0, 500)) AS i)")
def a2(spark, sf_dir):
    step = round(60 / 5)
    return spark.range(0, 6000, step).select(F.col("id").alias("frame"), (F.col("id") / step / 5).alias("time"))


JOBS = [Job("corner", (0.6, 0.0, 1.0, 0.3), 12), Job("bar", (0.0, 0.0, 1.0, 0.15), 18)]


@query("a3_aligned_union", "SELECT f::INTEGER AS frame, j AS job FROM (SELECT unnest(range(7, 3000)) AS f), (VALUES ('corner', 12), ('bar', 18)) t(j, s) WHERE f % s = 0")
def a3(spark, sf_dir):
    return sampled(spark, JOBS, 7, 3000)


@query("e23_distinct_frames", "SELECT DISTINCT f::INTEGER AS frame FROM (SELECT unnest(range(7, 3000)) AS f) WHERE f % 12 = 0 OR f % 18 = 0")
def e23(spark, sf_dir):
    return sampled(spark, JOBS, 7, 3000).select("frame").distinct()


@query("mu4_chunk_plan", "SELECT k AS chunk, 100 + k * 54 AS first, CASE WHEN k = 15 THEN 977 ELSE 100 + (k + 1) * 54 END AS after FROM (SELECT unnest(range(16)) AS k)")
def mu4(spark, sf_dir):
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(plan_ranges(100, 977, 4))], "chunk long, first long, after long")


@query("mu5_chunks", "SELECT event_id // 7 AS chunk, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY 1")
def mu5(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 7").alias("chunk"), "event_id")
    return e.groupBy("chunk").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("ids"))


def peaks(values):
    """(pos, value) of values above both neighbours and 0.2."""
    if values is not None:
        yield from ((i, float(b)) for i, (a, b, c) in enumerate(zip(values, values[1:], values[2:], strict=False), 1) if b > 0.2 and a < b > c)


def bounds(values):
    """(low, high), if there are any values."""
    if values:
        yield float(min(values)), float(max(values))


# two jobs with schemas of their own over one scan
@query("mu1_table_function", """WITH p AS (SELECT vec_id, label, unnest(range(2, len(embedding))) AS i, embedding AS e FROM embeddings)
SELECT vec_id, label, 'peaks' AS job, CAST(i - 1 AS DOUBLE) AS a, round(CAST(e[i] AS DOUBLE), 6) AS b FROM p WHERE e[i] > 0.2 AND e[i - 1] < e[i] AND e[i] > e[i + 1]
UNION ALL SELECT vec_id, label, 'bounds', round(CAST(list_min(embedding) AS DOUBLE), 6), round(CAST(list_max(embedding) AS DOUBLE), 6) FROM embeddings""")
def mu1_table_function(spark, sf_dir):
    from ordwell.operators import jobs

    jobs.register(spark, "ordwell_job", jobs.RowJob("peaks", "pos int, value double", peaks), jobs.RowJob("bounds", "low double, high double", bounds))
    given = {"v": table(spark, sf_dir, "embeddings")}
    top = spark.sql("SELECT v.vec_id, v.label, 'peaks' AS job, CAST(j.pos AS DOUBLE) AS a, round(j.value, 6) AS b FROM {v} v, LATERAL ordwell_job('peaks', v.embedding) j", **given)
    ends = spark.sql("SELECT v.vec_id, v.label, 'bounds' AS job, round(j.low, 6) AS a, round(j.high, 6) AS b FROM {v} v, LATERAL ordwell_job('bounds', v.embedding) j", **given)
    return top.unionByName(ends)


@query("mu1_udtf", "SELECT vec_id, unnest(range(CAST(vec_id % 3 AS BIGINT))) AS row FROM embeddings")
def mu1(spark, sf_dir):
    def detect(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame([(v, k) for v in b["vec_id"].tolist() for k in range(v % 3)], columns=["vec_id", "row"])

    return table(spark, sf_dir, "embeddings").select("vec_id").mapInPandas(detect, "vec_id long, row long")


HEROES = 4
DRAWN = """SELECT n_nationkey AS frame, CAST(0 AS INTEGER) AS row, 'h' || (n_nationkey % 4) AS killer, CAST(n_regionkey % 2 AS INTEGER) AS killer_team,
  'h' || ((n_nationkey + 1 + n_regionkey % 3) % 4) AS victim, CAST((n_nationkey // 2) % 2 AS INTEGER) AS victim_team, CASE WHEN n_nationkey % 3 = 1 THEN 'a' || (n_nationkey % 4) END AS ability FROM nation"""


def drawn_regions(spark, sf_dir):
    """A kill-feed region for each nation, drawn in workers: who killed whom follows from the nation's keys."""

    def draw(batches):
        import pyarrow as pa

        from ordwell.sources import drawn

        for b in batches:
            out = []
            for n, g in zip(b.column("n_nationkey").to_pylist(), b.column("n_regionkey").to_pylist(), strict=True):
                row = {"killer": (n % HEROES, g % 2), "victim": ((n + 1 + g % 3) % HEROES, n // 2 % 2), "assist": None, "sign": n % HEROES if n % 3 == 1 else None}
                image = drawn.region([row], n)
                out.append({"match_id": 0, "frame": n, "height": image.shape[0], "width": image.shape[1], "channels": 3, "data": image.tobytes()})
            ints = [(c, pa.int32()) for c in ("frame", "height", "width", "channels")]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("match_id", pa.int64()), *ints, ("data", pa.binary())]))

    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return nations.mapInArrow(draw, "match_id long, frame int, height int, width int, channels int, data binary")


@query("k23_detection", DRAWN)
def k23(spark, sf_dir):
    from ordwell.operators import detection
    from ordwell.sources import drawn

    found = detection.detect_rows(drawn_regions(spark, sf_dir), drawn.references(HEROES), strict=True)
    return found.select(F.col("frame").cast("long").alias("frame"), "row", F.col("player1.hero").alias("killer"), F.col("player1.team").alias("killer_team"), F.col("player2.hero").alias("victim"), F.col("player2.team").alias("victim_team"), F.col("ability.name").alias("ability"))


@query("a10_paged_scan", "SELECT printf('Picture_%06d.png', i) AS name, 'https://example.org/' || i AS url FROM (SELECT unnest(range(1234)) AS i)")
def a10(spark, sf_dir):
    from ordwell.sources import paged

    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("ordwell_paged").option("fetch", "ordwell.sources.paged:made_up").option("fetch.rows", "1234").load()

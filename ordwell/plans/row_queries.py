"""Queries over kill-row boxes, and small set and order operators, with their oracles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ordwell.operators import killrows
from ordwell.plans.registry import query
from ordwell.session import table

ROW = """rw AS (SELECT event_id, 100 + event_id % 50 AS a1, 120 + event_id % 50 AS a2, 40 + event_id % 37 AS k2, 150 + event_id % 90 AS v1,
  CASE WHEN event_id % 3 = 0 THEN 10 + event_id % 30 END AS s2, CASE WHEN event_id % 4 <> 1 THEN 5 + event_id % 25 END AS b2, event_id % 5 = 0 AS env FROM events)"""


@query("j31_roles", "SELECT event_id, CASE WHEN event_id % 60 < 30 THEN 'h1' ELSE NULL END AS subject, CASE WHEN event_id % 60 <= 30 OR event_id % 60 >= 40 THEN 'h2' ELSE 'h1' END AS object FROM events")
def j31(spark, sf_dir):
    x = (F.col("event_id") % 60).cast("int")
    second = F.when(x < 30, F.lit(90)).when(x >= 40, F.lit(95)).otherwise(F.lit(20) + 10)
    heroes = F.array(F.struct(x.alias("x"), F.lit("h1").alias("hero")), F.struct(second.alias("x"), F.lit("h2").alias("hero")))
    return table(spark, sf_dir, "events").select("event_id", killrows.roles(heroes, F.lit(30)).alias("r")).select("event_id", "r.*")


@query("j32_row_flags", f"""WITH {ROW}, g AS (SELECT *, a2 - a1 AS w, a1 - k2 AS r, a1 - k2 - coalesce(s2, 0) AS rest FROM rw)
SELECT event_id, r >= 2.5 * w AND s2 IS NOT NULL AS has_assist, r >= 2.5 * w AND (s2 IS NULL OR rest >= 1.5 * w) AND b2 IS NOT NULL AS has_ability,
  r >= 2.5 * w AND (s2 IS NULL OR rest >= 1.5 * w) AND (b2 IS NULL OR rest - b2 >= w) AS is_critical, v1 - a2 >= 2 * w AND env AS is_environmental FROM g""")
def j32(spark, sf_dir):
    e = F.col("event_id")
    f = killrows.flags(100 + e % 50, 120 + e % 50, 40 + e % 37, 150 + e % 90, F.when(e % 3 == 0, 10 + e % 30), F.when(e % 4 != 1, 5 + e % 25), e % 5 == 0)
    return table(spark, sf_dir, "events").select("event_id", f.alias("f")).select("event_id", "f.*")


@query("c18_far_from_extremes", """WITH x AS (SELECT label, vec_id, floor(abs(embedding[1]) * 300) AS x FROM embeddings), m AS (SELECT label, min(x) AS lo, max(x) AS hi FROM x GROUP BY label)
SELECT vec_id FROM x JOIN m USING (label) WHERE x - lo >= 15 AND hi - x >= 15""")
def c18(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.floor(F.abs(F.col("embedding")[0]) * F.lit(300).cast("float")).alias("x"))
    w = Window.partitionBy("label")
    return v.withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max("x").over(w)).where("x - lo >= 15 and hi - x >= 15").select("vec_id")


@query("c19_projection", "SELECT vec_id, embedding[3]::DOUBLE AS a, embedding[4]::DOUBLE AS b FROM embeddings")
def c19(spark, sf_dir):
    part = F.slice(F.col("embedding").cast("array<double>"), 3, 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", part[0].alias("a"), part[1].alias("b"))


@query("e19_column_sums", "SELECT label, i AS col, round(sum(v), 4) AS total FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(list_transform(embedding, lambda x: x::DOUBLE)) AS v FROM embeddings) GROUP BY label, i")
def e19(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "v"))
    return v.groupBy("label", F.col("col").cast("long").alias("col")).agg(F.round(F.sum("v"), 4).alias("total"))


@query("e22_concat_results", "WITH r AS (SELECT min(event_id) AS a, (max(event_id) + 1 - min(event_id)) // 4 AS size FROM events) SELECT event_id, least((event_id - a) // size, 3) AS chunk FROM events, r")
def e22(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    bounds = e.agg(F.min("event_id").alias("a"), F.expr("(max(event_id) + 1 - min(event_id)) div 4").alias("size"))  # one row
    return e.join(F.broadcast(bounds)).select("event_id", F.expr("if(size > 0, least((event_id - a) div size, 3), 3)").alias("chunk"))


@query("h6_shared_ability", "SELECT n_name AS hero, 'a' || n_nationkey AS ability FROM nation UNION ALL SELECT n_name, 'melee' FROM nation")
def h6(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    abilities = F.array_append(F.array(F.concat(F.lit("a"), F.col("n_nationkey").cast("string"))), F.lit("melee"))
    return n.select(F.col("n_name").alias("hero"), F.explode(abilities).alias("ability"))


@query("g7_score_order", "SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY embedding[5] DESC, vec_id) AS ids FROM embeddings GROUP BY label")
def g7(spark, sf_dir):
    g = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct((-F.col("embedding")[4]).alias("s"), "vec_id"))).alias("l"))
    return g.select("label", F.array_join(F.transform("l", lambda x: x["vec_id"].cast("string")), ",").alias("ids"))


@query("g8_argmax", "SELECT event_type, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY event_type")
def g8(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"))


@query("g9_sorted_frames", "SELECT string_agg(f::VARCHAR, ',' ORDER BY f) AS frames FROM (SELECT DISTINCT event_id % 97 AS f FROM events)")
def g9(spark, sf_dir):
    frames = table(spark, sf_dir, "events").agg(F.array_sort(F.collect_set(F.col("event_id") % 97)).alias("f"))  # at most 97 values
    return frames.select(F.array_join(F.col("f").cast("array<string>"), ",").alias("frames"))


@query("j3_split_time", "SELECT event_id, event_id % 24 AS h, event_id % 60 AS m FROM events")
def j3(spark, sf_dir):
    parts = F.split(F.format_string("%02d:%02d:00", F.col("event_id") % 24, F.col("event_id") % 60), ":")
    return table(spark, sf_dir, "events").select("event_id", parts[0].cast("long").alias("h"), parts[1].cast("long").alias("m"))


@query("j15_hps", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 0 ELSE 100 END AS hps FROM lineitem")
def j15(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "A", 0).otherwise(100).alias("hps"))


@query("j16_percent", "SELECT event_id, (event_id % 101)::VARCHAR || '%' AS shown FROM events")
def j16(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat((F.col("event_id") % 101).cast("string"), F.lit("%")).alias("shown"))


@query("j20_tensor_math", "SELECT vec_id, round(sqrt(exp(-abs(embedding[1]::DOUBLE)) * pow(abs(embedding[2]::DOUBLE), 0.4) * pow(abs(sin(2 * atan2(embedding[3]::DOUBLE, embedding[4]::DOUBLE))), 0.6)), 6) AS s FROM embeddings")
def j20(spark, sf_dir):
    e = [F.col("embedding")[k].cast("double") for k in range(4)]
    s = F.sqrt(F.exp(-F.abs(e[0])) * F.pow(F.abs(e[1]), F.lit(0.4)) * F.pow(F.abs(F.sin(2 * F.atan2(e[2], e[3]))), F.lit(0.6)))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(s, 6).alias("s"))


@query("dj11_job_membership", "SELECT event_id FROM events WHERE event_id % 15 = 0 OR event_id % 20 = 0")
def dj11(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    steps = F.array(F.lit(15), F.lit(20))
    return e.where(F.exists(steps, lambda s: F.col("event_id") % s == 0))


@query("l6_sliding", "SELECT epoch_us(s) // 1000000 AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY 1")
def l6(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")

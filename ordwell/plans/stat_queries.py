"""Queries over timelines, scalar functions, set operations and shaping, with their oracles."""

from pyspark.sql import functions as F

from ordwell.functions import text as t
from ordwell.operators import stats as st
from ordwell.plans.registry import query
from ordwell.session import table
from ordwell.sources.adapters import GAP, TL, timeline

FIGHTS = f"""{TL},
el AS (SELECT *, lag(time_s) OVER w AS p FROM tl WHERE action = 'Eliminate' WINDOW w AS (PARTITION BY match_id ORDER BY time_s, event_id)),
fi AS (SELECT *, sum(CASE WHEN p IS NULL OR time_s - p > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY time_s, event_id) AS fight FROM el),
sep AS (SELECT match_id, (time_s + p) / 2 AS separation FROM el WHERE time_s - p > {GAP} UNION ALL SELECT DISTINCT match_id, 0.0::DOUBLE FROM tl)"""
tl = timeline


@query("c5_time_range", f"WITH {TL} SELECT event_id FROM tl WHERE action = 'Eliminate' AND time_s BETWEEN 50000 AND 900000")
def c5(spark, sf_dir):
    return st.eliminations(tl(spark, sf_dir), 50000, 900000).select("event_id")


@query("e9_kills", f"WITH {TL} SELECT match_id, subject::INTEGER AS subject, count(*) AS kills FROM tl WHERE action = 'Eliminate' GROUP BY ALL")
def e9(spark, sf_dir):
    return st.kills_by_player(tl(spark, sf_dir)).select("match_id", "subject", "kills")


@query("e10_net_deaths", f"WITH {TL} SELECT match_id, object::INTEGER AS object, CAST(sum(CASE WHEN action IN ('Eliminate', 'Suicide') THEN 1 WHEN action = 'Resurrect' THEN -1 ELSE 0 END) AS BIGINT) AS deaths FROM tl GROUP BY ALL")
def e10(spark, sf_dir):
    return tl(spark, sf_dir).groupBy("match_id", "object").agg(st.net_deaths(F.col("action")).alias("deaths"))


@query("e11_top_killer", f"WITH {TL}, k AS (SELECT match_id, subject, count(*) AS kills, min(event_id) AS seen FROM tl WHERE action = 'Eliminate' GROUP BY ALL) SELECT match_id, subject::INTEGER AS subject, kills FROM k QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY kills DESC, seen) = 1")
def e11(spark, sf_dir):
    return st.MatchStats(tl(spark, sf_dir)).top_killer()


KD = """r AS (SELECT match_id, event_id, unnest([subject, object]) AS slot, unnest([1, 0]) AS k, unnest([0, 1]) AS d FROM tl WHERE action = 'Eliminate'),
kd AS (SELECT match_id, slot, sum(k) AS kills, sum(d) AS deaths, min(event_id) AS seen FROM r GROUP BY ALL)"""


@query("e12_top_kd", f"WITH {TL}, {KD} SELECT match_id, slot::INTEGER AS slot, kills / greatest(deaths, 1) AS ratio FROM kd QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY kills / greatest(deaths, 1) DESC, seen) = 1")
def e12(spark, sf_dir):
    return st.MatchStats(tl(spark, sf_dir)).top_ratio()


@query("f15_separations", f"WITH {FIGHTS} SELECT match_id, separation FROM sep")
def f15(spark, sf_dir):
    return st.separations(tl(spark, sf_dir), GAP)


@query("f16_fight_index", f"WITH {FIGHTS} SELECT event_id, (SELECT count(*) FROM sep WHERE sep.match_id = tl.match_id AND separation <= time_s) AS fight FROM tl")
def f16(spark, sf_dir):
    return st.fight_index(tl(spark, sf_dir), GAP).select("event_id", "fight")


@query("f17_fights", f"WITH {FIGHTS} SELECT match_id, CAST(fight AS BIGINT) AS fight, string_agg(event_id::VARCHAR, ',' ORDER BY time_s, event_id) AS events FROM fi GROUP BY ALL")
def f17(spark, sf_dir):
    g = st.fights(tl(spark, sf_dir), GAP).groupBy("match_id", "fight").agg(F.sort_array(F.collect_list(F.struct("time_s", "event_id"))).alias("l"))
    return g.select("match_id", "fight", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("events"))


@query("e14_avg_fight", f"WITH {FIGHTS}, f AS (SELECT match_id, fight, max(time_s) - min(time_s) + 7 AS d FROM fi GROUP BY ALL) SELECT match_id, round(avg(d), 4) AS duration FROM f GROUP BY match_id")
def e14(spark, sf_dir):
    return st.MatchStats(tl(spark, sf_dir), gap=GAP).mean_fight().withColumn("duration", t.rounded(F.col("duration"), 4))


@query("e15_fight_count", f"WITH {FIGHTS} SELECT match_id, count(DISTINCT fight) AS fights FROM fi GROUP BY match_id")
def e15(spark, sf_dir):
    return st.fights(tl(spark, sf_dir), GAP).groupBy("match_id").agg(F.count_distinct("fight").alias("fights"))


TIME = "format('{:02d}:{:02d}:{:02d}.{:d}', CAST(floor(s / 3600) AS BIGINT), CAST(floor(s / 60) AS BIGINT) % 60, CAST(floor(s) AS BIGINT) % 60, CAST(floor((s - floor(s)) * 10 + 1e-9) AS BIGINT))"


@query("j1_time_format", f"WITH {TL}, x AS (SELECT event_id, round(time_s / 40, 2) AS s FROM tl) SELECT event_id, {TIME} AS text FROM x")
def j1(spark, sf_dir):
    return tl(spark, sf_dir).select("event_id", t.time_format(t.rounded(F.col("time_s") / 40, 2)).alias("text"))


@query("j2_hms", "SELECT event_id, (event_id % 24) * 3600 + (event_id % 60) * 60 + (event_id % 7) + CAST(0.5 AS DOUBLE) AS seconds FROM events")
def j2(spark, sf_dir):
    text = F.format_string("%02d:%02d:%02d.5", F.col("event_id") % 24, F.col("event_id") % 60, F.col("event_id") % 7)
    return table(spark, sf_dir, "events").select("event_id", t.hms_to_seconds(text).alias("seconds"))


HERO = "['dva', 'mccree', 'soldier76', 'meka', 'ANA', 'widowMaker', 'empty', 'ßx y'][CAST(event_id % 8 AS INTEGER) + 1]"


def hero(c="event_id"):
    names = ["dva", "mccree", "soldier76", "meka", "ANA", "widowMaker", "empty", "ßx y"]
    return F.get(F.array(*map(F.lit, names)), (F.col(c) % 8).cast("int"))


# the first letter's title form may be two letters (ß), which DuckDB's upper() writes as one
@query("j4_display_name", f"SELECT event_id, CASE {HERO} WHEN 'dva' THEN 'D. Va' WHEN 'meka' THEN 'MEKA' WHEN 'soldier76' THEN 'Soldier: 76' ELSE replace(upper(left({HERO}, 1)), 'ẞ', 'Ss') || lower(substr({HERO}, 2)) END AS shown FROM events")
def j4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.display_name(hero()).alias("shown"))


@query("j5_upper", f"SELECT event_id, CASE WHEN {HERO} = 'empty' THEN '' WHEN regexp_full_match({HERO}, '[A-Za-z ]*') THEN upper({HERO}) ELSE {HERO} END AS shown FROM events")
def j5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.upper_ascii(hero()).alias("shown"))


@query("j6_hex", "SELECT event_id, printf('%02X%02X%02X', event_id % 256, (event_id * 7) % 256, (event_id * 13) % 256) AS rgb, ((event_id % 256) + (event_id * 7) % 256 + (event_id * 13) % 256) / 3 < 95 AS is_deep FROM events")
def j6(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", t.hex_colour((e * 13) % 256, (e * 7) % 256, e % 256).alias("c")).select("event_id", "c.*")


@query("j7_stem", "SELECT page_id, split_part(url, '.', 1) AS stem FROM pages")
def j7(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.stem(F.col("url")).alias("stem"))


@query("j8_last_stem", "SELECT page_id, regexp_replace(url, '\\.[^.]*$', '') AS stem FROM pages")
def j8(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.last_stem(F.col("url")).alias("stem"))


@query("j9_parse_at", """WITH x AS (SELECT event_id, 'n' || event_id || '@' || ['Ultimate', 'weapon_main', 'x passive', 'skill'][CAST(event_id % 4 AS INTEGER) + 1] || CASE WHEN event_id % 3 = 0 THEN '@e' ELSE '' END AS s FROM events)
SELECT event_id, split_part(s, '@', 1) AS name, CASE WHEN s ILIKE '%@%ult%' THEN 'ultimate' WHEN s LIKE '%pass%' THEN 'passive' WHEN s LIKE '%weapon%' THEN 'weapon' ELSE 'ability' END AS category, nullif(split_part(s, '@', 3), '') AS bind FROM x""")
def j9(spark, sf_dir):
    kind = F.get(F.array(*map(F.lit, ["Ultimate", "weapon_main", "x passive", "skill"])), (F.col("event_id") % 4).cast("int"))
    s = F.concat(F.lit("n"), F.col("event_id").cast("string"), F.lit("@"), kind, F.when(F.col("event_id") % 3 == 0, "@e").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", t.icon_parts(s).alias("p")).select("event_id", "p.*")


@query("j10_formats", f"WITH {TL} SELECT event_id, 'Switch from h' || subject || ' to h' || object AS change, lpad(subject::VARCHAR, 2, '0') || ' p' AS label FROM tl")
def j10(spark, sf_dir):
    return tl(spark, sf_dir).select("event_id", F.format_string("Switch from h%d to h%d", "subject", "object").alias("change"), F.format_string("%02d p", "subject").alias("label"))


@query("j11_label_parse", f"WITH {TL} SELECT event_id, subject::INTEGER AS idx, 'p' || object AS name FROM tl")
def j11(spark, sf_dir):
    label = F.format_string("%02d p%d", "subject", "object")
    return tl(spark, sf_dir).select("event_id", F.substring(label, 1, 2).cast("int").alias("idx"), F.substring(label, 4, 100).alias("name"))


ACT = "['mercy', 'ana', NULL, 'empty'][CAST(event_id % 4 AS INTEGER) + 1]"


@query("j13_action", f"""WITH x AS (SELECT event_id, {ACT} AS kh, event_id % 2 AS kt, CASE WHEN event_id % 5 = 0 THEN 'meka' ELSE 'ana' END AS vh, (event_id // 2) % 2 AS vt FROM events),
a AS (SELECT event_id, CASE WHEN kh = 'mercy' AND kt = vt THEN 'Resurrect' WHEN vh = 'meka' THEN 'Demech' WHEN kh IS NULL OR kh IN ('', 'empty') THEN 'Suicide' ELSE 'Eliminate' END AS action FROM x)
SELECT event_id, action, CASE action WHEN 'Resurrect' THEN 'Resurrect' WHEN 'Demech' THEN 'MEKA destroyed' ELSE '' END AS comments FROM a""")
def j13(spark, sf_dir):
    e = F.col("event_id")
    kh = F.get(F.array(F.lit("mercy"), F.lit("ana"), F.lit(None), F.lit("empty")), (e % 4).cast("int"))
    a = t.action(kh, e % 2, F.when(e % 5 == 0, "meka").otherwise("ana"), F.expr("(event_id div 2) % 2"))
    return table(spark, sf_dir, "events").select("event_id", a.alias("action")).withColumn("comments", t.comment(F.col("action")))


@query("j12_empty_normal", f"SELECT event_id, coalesce(nullif({ACT}, 'empty'), '') AS hero FROM events")
def j12(spark, sf_dir):
    kh = F.get(F.array(F.lit("mercy"), F.lit("ana"), F.lit(None), F.lit("empty")), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nullif(kh, F.lit("empty")), F.lit("")).alias("hero"))


@query("dj14_object_owner", "SELECT event_id, coalesce(map{'meka': 'dva', 'riptire': 'junkrat', 'shield': 'symmetra', 'supercharger': 'orisa', 'teleporter': 'symmetra', 'turret': 'torbjon'}[o], o) AS owner FROM (SELECT event_id, ['meka', 'turret', 'ana', 'shield'][CAST(event_id % 4 AS INTEGER) + 1] AS o FROM events)")
def dj14(spark, sf_dir):
    o = F.get(F.array(*map(F.lit, ["meka", "turret", "ana", "shield"])), (F.col("event_id") % 4).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", t.owner(o).alias("owner"))


@query("j18_rounding", "SELECT event_id, round_even(value, 1) AS even, CAST(ceil(value) AS BIGINT) AS up, CAST(floor(value) AS BIGINT) AS down, CAST(trunc(value) AS INTEGER) AS cut FROM events")
def j18(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.bround(v, 1).alias("even"), F.ceil(v).alias("up"), F.floor(v).alias("down"), v.cast("int").alias("cut"))


@query("j19_colour_distance", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 4) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def j19(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = v.where("vec_id = 0").select(F.col("e").alias("o")).limit(1)
    return v.join(F.broadcast(one)).select("vec_id", F.round(t.distance(F.col("e"), F.col("o")), 4).alias("dist"))  # one row


@query("k2_ncc", """WITH p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS a, list_transform(b.embedding, lambda x: x::DOUBLE) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = 1),
u AS (SELECT vec_id, unnest(a) AS x, unnest(b) AS y FROM p) SELECT vec_id, round(corr(x, y), 4) AS ncc FROM u GROUP BY vec_id""")
def k2(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = v.where("vec_id = 1").select(F.col("e").alias("o")).limit(1)
    return v.join(F.broadcast(one)).select("vec_id", F.round(t.correlation(F.col("e"), F.col("o")), 4).alias("ncc"))  # one row


@query("k1_iou", """WITH p AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = 2),
u AS (SELECT vec_id, unnest(a) > 0 AS x, unnest(b) > 0 AS y FROM p) SELECT vec_id, round(sum((x AND y)::INT) / (sum((x OR y)::INT) + 1e-6), 6) AS iou FROM u GROUP BY vec_id""")
def k1(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = v.where("vec_id = 2").select(F.col("e").alias("o")).limit(1)
    return v.join(F.broadcast(one)).select("vec_id", F.round(t.binary_iou(F.col("e"), F.col("o"), 0.0), 6).alias("iou"))  # one row


DIMENSIONS = 64


@query("dj16_nearest", f"""WITH m AS (SELECT label, list(a ORDER BY i) AS m FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i) WHERE label < 2 GROUP BY ALL) GROUP BY label)
SELECT vec_id, arg_min(m.label, round(sqrt(list_sum(list_transform(list_zip(e.embedding, m.m), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))), 9)) AS nearest FROM embeddings e, m GROUP BY vec_id""")
def dj16(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    m = v.where("label < 2").groupBy("label").agg(F.array(*(F.avg(F.col("e")[k]) for k in range(DIMENSIONS))).alias("m"))
    near = v.select("vec_id", "e").crossJoin(F.broadcast(m))  # two rows
    return near.groupBy("vec_id").agg(F.min_by("label", F.round(t.distance(F.col("e"), F.col("m")), 9)).alias("nearest"))


@query("j21_linspace", "SELECT event_id, array_to_string(list_transform(range(event_id % 5 + 1), lambda i: CAST(CASE WHEN event_id % 5 = 0 THEN 10 ELSE 10 + i * 30 / (event_id % 5) END AS INTEGER)), ',') AS steps FROM events")
def j21(spark, sf_dir):
    n = (F.col("event_id") % 5 + 1).cast("int")
    s = F.transform(t.linspace(F.lit(10.0), F.lit(40.0), n), lambda x: F.bround(x, 0).cast("int").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(s, ",").alias("steps"))


@query("j22_clip", "SELECT event_id, greatest(10, least(value, 50)) AS clipped FROM events")
def j22(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(10.0), F.least("value", F.lit(50.0))).alias("clipped"))


@query("j23_box_centre", "SELECT event_id, (event_id % 100 + event_id % 300 + 5) // 2 AS cx FROM events")
def j23(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", "(event_id % 100 + event_id % 300 + 5) div 2 AS cx")


@query("j24_interval_extend", "SELECT event_id, greatest(0, event_id % 200 - CAST(trunc((event_id % 40) * 0.3) AS BIGINT)) AS first, least(300, event_id % 200 + event_id % 40 + CAST(trunc((event_id % 40) * 0.3) AS BIGINT)) AS last FROM events")
def j24(spark, sf_dir):
    x = F.expr("cast(cast(event_id % 40 as double) * 0.3D as bigint)")
    a, n = F.col("event_id") % 200, F.col("event_id") % 40
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0), a - x).alias("first"), F.least(F.lit(300), a + n + x).alias("last"))


@query("j25_roi", "SELECT event_id, CAST(round_even(1280 * (event_id % 50) / 100, 0) AS BIGINT) AS x, CAST(round_even(720 * (event_id % 25) / 100, 0) AS BIGINT) AS y FROM events")
def j25(spark, sf_dir):
    px = lambda size, m: F.bround(size * (F.col("event_id") % m) / 100, 0).cast("long")
    return table(spark, sf_dir, "events").select("event_id", px(1280, 50).alias("x"), px(720, 25).alias("y"))


@query("j26_slot_positions", "SELECT unnest(range(12)) AS slot, CASE WHEN unnest(range(12)) < 6 THEN 30 + unnest(range(12)) * 70 ELSE 815 + (unnest(range(12)) - 6) * 70 END AS x")
def j26(spark, sf_dir):
    s = F.col("slot")
    return spark.range(12).withColumnRenamed("id", "slot").select("slot", F.when(s < 6, 30 + s * 70).otherwise(815 + (s - 6) * 70).alias("x"))


@query("j27_first_match", f"WITH {TL} SELECT event_id, CASE WHEN object > 3 THEN 4 ELSE -1 END AS found FROM tl")
def j27(spark, sf_dir):
    hit = F.get(F.filter(F.sequence(F.lit(0), F.col("object")), lambda x: x > 3), 0)
    return tl(spark, sf_dir).select("event_id", F.coalesce(hit, F.lit(-1)).alias("found"))


@query("j28_default_fill", f"WITH {TL} SELECT event_id, CASE WHEN subject = 5 THEN '0,1,2,3,4,5' ELSE '1,2,3,4,5,6' END AS names FROM tl")
def j28(spark, sf_dir):
    names = F.sequence(F.lit(0), F.col("subject"))
    six = F.when(F.size(names) == 6, names).otherwise(F.array(*map(F.lit, range(1, 7))))
    return tl(spark, sf_dir).select("event_id", F.array_join(six.cast("array<string>"), ",").alias("names"))


@query("j29_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def j29(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", "p.k")


@query("j30_assist_map", f"WITH {TL} SELECT event_id, '{{\"1\":\"h' || subject || '\",\"2\":\"h' || object || '\"}}' AS assist FROM tl")
def j30(spark, sf_dir):
    h = lambda c: F.concat(F.lit("h"), F.col(c).cast("string"))
    return tl(spark, sf_dir).select("event_id", F.to_json(F.map_from_entries(F.array(F.struct(F.lit("1"), h("subject")), F.struct(F.lit("2"), h("object"))))).alias("assist"))


@query("j34_arguments", "SELECT event_id, (event_id % 9)::VARCHAR AS fps, 'x' || event_id AS video FROM events")
def j34(spark, sf_dir):
    line = F.format_string("fps=%d video=x%d", F.col("event_id") % 9, F.col("event_id"))
    a = t.arguments(line)
    return table(spark, sf_dir, "events").select("event_id", a["fps"].alias("fps"), a["video"].alias("video"))


@query("c11_regex_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://(www|blog)\\.') AND NOT regexp_matches(url, '(utm_|#top)')")
def c11(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^(?!.*(utm_|#top))https?://(www|blog)\.")).select("page_id")


@query("c17_presence", "SELECT vec_id, len(list_filter(embedding, lambda x: x >= 0.3)) > 0 AS present FROM embeddings")
def c17(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.exists("embedding", lambda x: x >= F.lit(0.3).cast("float")).alias("present"))


@query("c20_seen_skip", "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def c20(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.join(p.where("page_id % 3 = 0").select("url"), "url", "left_anti").select("page_id")


@query("h1_union_all", "SELECT event_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id FROM events WHERE event_id % 3 = 0")
def h1(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return e.where("event_id % 2 = 0").unionByName(e.where("event_id % 3 = 0"))


@query("h2_union_distinct", "SELECT user_id FROM events WHERE event_id % 2 = 0 UNION SELECT user_id FROM events WHERE event_id % 3 = 0")
def h2(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_id % 2 = 0").select("user_id").union(e.where("event_id % 3 = 0").select("user_id")).distinct()


@query("h3_append_ranges", f"WITH {TL} SELECT event_id FROM tl WHERE action = 'Eliminate' AND time_s BETWEEN 0 AND 90000 UNION ALL SELECT event_id FROM tl WHERE action = 'Eliminate' AND time_s BETWEEN 200000 AND 400000")
def h3(spark, sf_dir):
    x = tl(spark, sf_dir)
    return st.eliminations(x, 0, 90000).unionByName(st.eliminations(x, 200000, 400000)).select("event_id")


@query("h4_except", "SELECT url FROM pages WHERE page_id % 2 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0")
def h4(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.where("page_id % 2 = 0").select("url").subtract(p.where("page_id % 3 = 0").select("url"))


@query("h5_event_union", f"WITH {TL} SELECT event_id, action AS kind, time_s, NULL::INTEGER AS slot FROM tl WHERE action = 'Eliminate' UNION ALL SELECT event_id, 'switch', time_s - 1.5, subject::INTEGER FROM tl WHERE action = 'Demech'")
def h5(spark, sf_dir):
    x = tl(spark, sf_dir)
    kills = x.where("action = 'Eliminate'").select("event_id", F.col("action").alias("kind"), "time_s")
    switches = x.where("action = 'Demech'").select("event_id", F.lit("switch").alias("kind"), (F.col("time_s") - 1.5).alias("time_s"), F.col("subject").alias("slot"))
    return kills.unionByName(switches, allowMissingColumns=True)


@query("h7_intersect", "SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'error'")
def h7(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select("user_id").intersect(e.where("event_type = 'error'").select("user_id"))


@query("dj4_dim_lookup", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def dj4(spark, sf_dir):
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("dj5_config_default", "SELECT c_custkey, coalesce(n_regionkey * 10, 0) AS setting FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def dj5(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", "n_regionkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce(F.col("n_regionkey") * 10, F.lit(0)).alias("setting"))


@query("dj15_top_index", f"WITH {TL}, n AS (SELECT DISTINCT match_id, subject, 'p' || (subject % 5) AS name FROM tl) SELECT match_id, name, min(subject)::INTEGER AS idx FROM n GROUP BY ALL")
def dj15(spark, sf_dir):
    name = F.concat(F.lit("p"), (F.col("subject") % 5).cast("string"))
    return tl(spark, sf_dir).groupBy("match_id", name.alias("name")).agg(F.min("subject").alias("idx"))


@query("g2_event_order", f"WITH {TL} SELECT event_id, row_number() OVER (PARTITION BY match_id ORDER BY time_s, event_id) AS place FROM tl")
def g2(spark, sf_dir):
    return tl(spark, sf_dir).select("event_id", F.row_number().over(st.in_match()).cast("long").alias("place"))


@query("g6_reverse", f"WITH {TL} SELECT match_id, string_agg(event_id::VARCHAR, ',' ORDER BY time_s DESC, event_id DESC) AS events FROM tl GROUP BY match_id")
def g6(spark, sf_dir):
    g = tl(spark, sf_dir).groupBy("match_id").agg(F.reverse(F.sort_array(F.collect_list(F.struct("time_s", "event_id")))).alias("l"))
    return g.select("match_id", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("events"))


@query("b3_timeline", f"WITH {TL}, x AS (SELECT *, time_s AS s FROM tl) SELECT event_id, {TIME} AS time, action, 'p' || subject AS subject, 'p' || object AS object, CASE action WHEN 'Resurrect' THEN 'Resurrect' WHEN 'Demech' THEN 'MEKA destroyed' ELSE '' END AS comments FROM x")
def b3(spark, sf_dir):
    p = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias(c)
    return tl(spark, sf_dir).select("event_id", t.time_format(F.col("time_s")).alias("time"), "action", p("subject"), p("object"), t.comment(F.col("action")).alias("comments"))


@query("b5_nested_json", f"WITH {TL} SELECT event_id, '{{\"action\":\"' || action || '\",\"subject\":{{\"player\":' || subject || '}},\"object\":{{\"player\":' || object || '}}}}' AS json FROM tl")
def b5(spark, sf_dir):
    one = lambda c: F.struct(F.col(c).alias("player")).alias(c)
    return tl(spark, sf_dir).select("event_id", F.to_json(F.struct("action", one("subject"), one("object"))).alias("json"))


@query("x_rollup", "SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("g")).rollup("event_type", "g").agg(F.count("*").alias("n"))


@query("x_cube", "SELECT event_type, user_id % 3 AS g, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).alias("g")).cube("event_type", "g").agg(F.count("*").alias("n"))


@query("l5_tumbling", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1")
def l5(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


@query("l4_session_window", f"WITH {TL}, x AS (SELECT match_id, time_s, time_s - lag(time_s) OVER (PARTITION BY match_id ORDER BY time_s) AS d FROM tl WHERE action = 'Eliminate'), g AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY time_s) AS s FROM x) SELECT match_id, count(*) AS n FROM g GROUP BY match_id, s")
def l4(spark, sf_dir):
    k = st.eliminations(tl(spark, sf_dir)).withColumn("ts", F.timestamp_micros((F.col("time_s") * 1000000).cast("long")))
    return k.groupBy("match_id", F.session_window("ts", f"{int(GAP)} seconds")).agg(F.count("*").alias("n")).select("match_id", "n")

"""Queries over frames as bytes, with their oracles: each vector of embeddings is a picture, five by four pixels of three channels."""

import uuid

from pyspark.sql import functions as F

from ordwell.operators import validity
from ordwell.plans.registry import query
from ordwell.session import shared_folder, table
from ordwell.sources import clip_stream

WIDTH, CHANNELS = 5, 3
VERSIONS = [validity.Version(0, (3, 0, 2, 2), 26.0, 132.0), validity.Version(1, (0, 0, 2, 2), 30.0, 126.0), validity.Version(2, (1, 1, 4, 3), 34.0, 120.0)]


def pictures(spark, sf_dir):
    """(match_id, frame, width, data, alive) of all vectors: a byte for each of the first 60 values."""
    v = table(spark, sf_dir, "embeddings")
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 255 + 128))).cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 60), byte), ""))
    return v.select(F.col("label").alias("match_id"), F.col("vec_id").alias("frame"), F.lit(WIDTH).alias("width"), data.alias("data"), (F.col("vec_id") % 7 != 3).alias("alive"))


def _valid_sql(v):
    """Whether version v's corner of the bytes px is plain and bright."""
    x, y, w, h = v.corner
    n = w * h
    corner = [f"[{', '.join(f'px[{((y + i // w) * WIDTH + x + i % w) * CHANNELS + k + 1}]' for i in range(n))}]" for k in range(CHANNELS)]
    spread = ", ".join(f"sqrt((list_sum(list_transform({c}, lambda p: p * p)) * {n} - list_sum({c}) * list_sum({c}))::DOUBLE) / {n}" for c in corner)
    mean = f"({' + '.join(f'list_sum({c})' for c in corner)})::DOUBLE / {n * CHANNELS}"
    return f"coalesce(greatest({spread}) < {v.max_std} AND {mean} > {v.min_mean}, false)"


JUDGED = f"""px AS (SELECT label AS match_id, vec_id AS frame, vec_id % 7 <> 3 AS alive,
  list_transform(embedding[1:60], lambda v: greatest(0, least(255, floor(v::DOUBLE * 255 + 128)))::BIGINT) AS px FROM embeddings),
u AS (SELECT match_id, frame, alive AND {_valid_sql(VERSIONS[0])} AS v0, alive AND {_valid_sql(VERSIONS[1])} AS v1, alive AND {_valid_sql(VERSIONS[2])} AS v2 FROM px),
m AS (SELECT match_id, min(frame) AS since, arg_min(CASE WHEN v0 THEN 0 WHEN v1 THEN 1 ELSE 2 END, frame) AS version FROM u WHERE v0 OR v1 OR v2 GROUP BY match_id)"""


@query("c4_frame_pixels", f"""WITH {JUDGED} SELECT match_id, frame, version::INTEGER AS version,
  coalesce(frame >= since AND CASE version WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END, false) AS is_valid FROM u LEFT JOIN m USING (match_id)""")
def c4(spark, sf_dir):
    return validity.validated(validity.judged(pictures(spark, sf_dir), VERSIONS, CHANNELS)).select("match_id", "frame", "version", "is_valid")


@query("k32_version_pixels", f"WITH {JUDGED} SELECT match_id, since, version::INTEGER AS version FROM m")
def k32(spark, sf_dir):
    return validity.versions_of(validity.judged(pictures(spark, sf_dir), VERSIONS, CHANNELS))


@query("l3_frame_stream", """SELECT array_to_string(list_transform(embedding[1:60], lambda v: printf('%02X', greatest(0, least(255, floor(v::DOUBLE * 255 + 128)))::BIGINT)), '') AS picture, 4 AS height, 5 AS width
FROM embeddings WHERE embedding IS NOT NULL""")
def l3(spark, sf_dir):
    """The pictures written as clips by tasks, read back as a stream of at most 4,096 frames a batch."""
    folder = f"{shared_folder(spark)}/clips-{uuid.uuid4().hex}"
    shown = pictures(spark, sf_dir).select(F.lit(4).alias("height"), "width", F.lit(CHANNELS).alias("channels"), "data")
    clip_stream.write_clips(shown, f"{folder}/in")
    spark.dataSource.register(clip_stream.ClipStream)
    frames = spark.readStream.format("ordwell_clip_stream").options(path=f"{folder}/in", position=f"{folder}/at", frames="4096", per_task="512").load()
    out = frames.select(F.hex("data").alias("picture"), "height", "width")
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").option("path", f"{folder}/out").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")

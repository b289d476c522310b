"""Frames of clips as a stream: bounded batches, stops and restarts, clips that come later."""

import numpy as np
import pytest
from ordwell.sources import clip_stream as c
from ordwell.sources.frames import clips
from pyspark.sql import functions as F


def put(folder, name, n, seed):
    folder.mkdir(exist_ok=True)
    np.save(folder / name, np.random.default_rng(seed).integers(0, 256, (n, 3, 4, 3), dtype=np.uint8))


def test_offsets(tmp_path):
    put(tmp_path / "in", "a_100.npy", 10, 1)
    put(tmp_path / "in", "b_0.npy", 5, 2)
    put(tmp_path / "in", "empty_0.npy", 0, 2)
    (tmp_path / "in" / "other.txt").write_text("x")
    options = {"path": str(tmp_path / "in"), "position": f"file://{tmp_path}/at", "frames": "8", "per_task": "3"}
    r = c.ClipStreamReader(options)
    start = r.initialOffset()
    assert start == {} and r.latestOffset() == r.latestOffset() == {"a_100.npy": 8}
    assert [(p.first, p.after) for p in r.partitions(start, r.latestOffset())] == [(0, 3), (3, 6), (6, 8)]
    again = c.ClipStreamReader(options)  # after a stop
    end = again.latestOffset()
    assert end == {"a_100.npy": 10, "b_0.npy": 5}
    parts = again.partitions({"a_100.npy": 8}, end)
    assert [(p.clip, p.first, p.after) for p in parts] == [("a_100.npy", 8, 10), ("b_0.npy", 0, 3), ("b_0.npy", 3, 5)]
    assert [x for p in parts for b in again.read(p) for x in b["frame"].to_pylist()] == [108, 109, 0, 1, 2, 3, 4]
    assert again.latestOffset() == end and again.partitions(end, end) == []
    with pytest.raises(ValueError):
        c.ClipStreamReader(options | {"frames": "0"})
    assert c.ClipStreamReader(options | {"path": str(tmp_path / "none"), "position": str(tmp_path / "new")}).latestOffset() == {}


def test_each_frame_once_over_stops(spark, tmp_path):
    spark.dataSource.register(c.ClipStream)
    for k in range(3):
        put(tmp_path / "in", f"m{k}_{k * 1000}.npy", 7 + k, k)
    sizes = []

    def write(df, batch):
        rows = df.withColumn("batch", F.lit(batch))
        rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
        sizes.append(spark.read.parquet(f"{tmp_path}/out/batch={batch}").count())

    def failing(df, batch):
        if batch == n + 1:
            raise RuntimeError("stopped")
        write(df, batch)

    def run(sink):
        frames = spark.readStream.format("ordwell_clip_stream").options(path=str(tmp_path / "in"), position=str(tmp_path / "at"), frames="5", per_task="2").load()
        q = frames.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(sink).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run(write)
    assert sizes and max(sizes) <= 5 and sum(sizes) == 24
    put(tmp_path / "in", "a_5.npy", 11, 9)  # comes later, and sorts before
    n = len(sizes)
    with pytest.raises(Exception, match="stopped"):
        run(failing)
    run(write)
    assert max(sizes) <= 5
    columns = ["clip", "frame", "height", "width", "channels", "data"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*columns).collect())
    assert len(got) == 35 and got == sorted(tuple(r) for r in clips(spark, str(tmp_path / "in")).select(*columns).collect())


def test_clips_written_by_tasks(spark, tmp_path):
    rows = [(3, 4, 2, bytes([k % 256]) * 24) for k in range(25)] + [(3, 4, 2, None)]
    df = spark.createDataFrame(rows, "height int, width int, channels int, data binary").repartition(2)
    c.write_clips(df, f"file://{tmp_path}/in", most=4)
    c.write_clips(df, f"file://{tmp_path}/in", most=4)  # as a task that runs again
    back = clips(spark, str(tmp_path / "in"))
    assert sorted(bytes(r.data) for r in back.collect()) == sorted(r[3] for r in rows if r[3])
    assert {r.n for r in back.groupBy("clip").agg((F.max("frame") + 1 - F.count("*")).alias("n")).collect()} == {0}
    c.write_clips(df.limit(0), f"{tmp_path}/none")
    assert c.ClipStreamReader({"path": f"{tmp_path}/none", "position": f"{tmp_path}/p"}).latestOffset() == {}

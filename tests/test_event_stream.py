"""Streams of detections and catalogues: any order of files, late rows, restarts."""

import datetime as dt
import random

import pytest
from ordwell.operators import dedup as d
from ordwell.streaming import batches, events

SCHEMA = "match_id long, ts timestamp, frame int, row int, player1 struct<team: int, hero: string>, player2 struct<team: int, hero: string>, assists array<struct<team: int, hero: string>>, ability struct<category: string, name: string>, is_critical boolean, is_environmental boolean"
START = dt.datetime(2024, 1, 1)


def made(seed, frames=300):
    """Kills and resurrections of a few victims, shown for some frames each on changing rows."""
    rnd, rows = random.Random(seed), {}
    for _ in range(60):
        f, match, victim, team = rnd.randrange(frames), rnd.randrange(2), rnd.choice(["ana", "lucio"]), rnd.randrange(2)
        res = rnd.random() < 0.3
        killer = None if rnd.random() < 0.1 else (team if res else 1 - team, rnd.choice(["reaper", "mercy"]))
        for k in range(rnd.randrange(1, 6)):
            row = rnd.randrange(3)
            rows[match, f + k, row] = (match, START + dt.timedelta(seconds=f + k), f + k, row, killer, (team, victim), [(1 - team, "zen")] * rnd.randrange(2), ("ability", "a") if rnd.random() < 0.5 else None, rnd.random() < 0.5, False)
    return list(rows.values())


def stream(spark, rows, path, order, files=6):
    """rows dealt to files by time, read one file a batch in the order given."""
    rows = sorted(rows, key=lambda r: r[1])
    size = -(-len(rows) // files)
    for at, k in enumerate(order):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.parquet(f"{path}/{at}")
        import os
        import time

        for x in os.listdir(f"{path}/{at}"):
            os.utime(f"{path}/{at}/{x}", (time.time() - 1000 + at * 10,) * 2)  # the source reads older files first
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4, 5], [1, 0, 3, 2, 5, 4]])
def test_closed_chains_give_the_batch_result(spark, tmp_path, order):
    rows = made(len(order) + order[0])
    rows.append((9, START + dt.timedelta(seconds=100_000), 100_000, 0, None, (0, "end"), [], None, False, False))  # closes all others
    got = events.deduplicated(stream(spark, rows, tmp_path / "in", order), 4, watermark="120 seconds", frame_ms=1000)
    want = d.deduplicate(spark.createDataFrame(rows[:-1], SCHEMA).drop("ts"), 4).drop("cluster").select(*got.columns)
    assert plain(got) == plain(want) and len(plain(want)) > 30


def test_open_chains_wait_and_late_rows_are_dropped(spark, tmp_path):
    row = lambda f, hero: (1, START + dt.timedelta(seconds=f), f, 0, (1, "reaper"), (0, hero), [], None, False, False)
    rows = [row(f, "ana") for f in (0, 1, 2)] + [row(1000, "open"), row(1001, "open")]
    late = [row(3, "ana"), row(1002, "open")]  # the first is behind the watermark when it comes
    for k, part in enumerate((rows, late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        s = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        batches.run(events.deduplicate_stream(s, f"{tmp_path}/out", 4, watermark="10 seconds", frame_ms=1000), spark)
    shape = d.deduplicate(spark.createDataFrame([], SCHEMA).drop("ts"), 4).drop("cluster").schema
    assert [(r.merged2.hero, r.frame, r.n) for r in batches.written(spark, f"{tmp_path}/out", shape).collect()] == [("ana", 0, 3)]


def test_a_catalogue_stopped_and_started_has_each_row_once(spark, tmp_path):
    """The first run fails after it wrote a batch and before Spark noted it; the second writes that batch again."""
    schema = "name string, url string"
    for k, names in enumerate((["a", "b", "b"], ["b", "c", None], ["a", "d"])):
        spark.createDataFrame([(n, f"u{k}") for n in names], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    import os
    import time

    for k in range(3):
        for x in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{x}", (time.time() - 1000 + k * 10,) * 2)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/catalogue"

    def broken(rows, number):
        known = batches.written(spark, path, s.schema, number).select("name")
        rows.where("name is not null").dropDuplicates(["name"]).join(known, "name", "left_anti").select("name", "url").write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number == 1:
            raise RuntimeError("stopped here")

    failing = s.writeStream.foreachBatch(broken).option("checkpointLocation", f"{path}_state")
    with pytest.raises(Exception, match="stopped here"):
        batches.run(failing, spark)
    batches.run(batches.append_new_stream(s, path, "name"), spark)
    batches.run(batches.append_new_stream(s, path, "name"), spark)
    assert sorted(tuple(r) for r in batches.written(spark, path, s.schema).collect()) == [("a", "u0"), ("b", "u0"), ("c", "u1"), ("d", "u2")]

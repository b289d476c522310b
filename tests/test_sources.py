"""Frame source, dispatcher, files, kernels, streams, functions."""

import json
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordwell.functions import kernels as k
from ordwell.functions import text as t
from ordwell.operators import spatial, stats
from ordwell.sources import files, frames
from ordwell.streaming import sessions


brightness = k.brightness


@given(st.lists(st.integers(), max_size=40), st.integers(1, 12))
def test_chunks_hold_all_items_in_order(items, n):
    parts = frames.chunks(items, n)
    assert [x for p in parts for x in p] == items
    assert all(len(p) == n for p in parts[:-1]) and all(1 <= len(p) <= n for p in parts)


@given(st.integers(0, 500), st.integers(0, 3000), st.integers(1, 9), st.integers(1, 6))
def test_ranges_hold_all_frames_once(start, size, workers, each):
    ranges = frames.plan_ranges(start, start + size, workers, each)
    assert [f for a, b in ranges for f in range(a, b)] == list(range(start, start + size))
    assert len(ranges) <= workers * each + 1


def test_dispatch_does_not_depend_on_workers(spark, tmp_path):
    video = np.arange(40 * 8 * 10, dtype=np.uint8).reshape(40, 8, 10, 1)
    np.save(tmp_path / "v.npy", video)
    jobs = [frames.Job("a", (0.5, 0.0, 1.0, 0.5), 3, brightness), frames.Job("b", (0.0, 0.0, 1.0, 1.0), 5, brightness)]
    results = []
    for workers in (1, 3):
        d = frames.Dispatcher(spark, str(tmp_path / "v.npy"), 2, 31, workers)
        for j in jobs:
            d.register(j)
        results.append({n: sorted(map(tuple, df.collect())) for n, df in d.run().items()})
    assert results[0] == results[1]
    assert results[0]["a"] == [(f, float(video[f, 0:4, 5:10].mean())) for f in range(2, 31) if f % 3 == 0]
    with pytest.raises(ValueError):
        frames.Dispatcher(spark, "x").register(frames.Job("c", (0, 0, 1, 1), 1, lambda i, f: []))
    with pytest.raises(ValueError):
        frames.Job("d", (0, 0, 2, 1), 1)
    assert frames.Dispatcher(spark, "x").run() == {}


def test_config_roster_archive_catalogue(spark, tmp_path):
    for game, version, doc in (("owl", 0, {"VERSION": 3, "FPS": 2}), ("owl", 1, {"FPS": 4.5}), ("custom", 0, {"NAME": "x"})):
        (tmp_path / "c" / game).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / game / f"{version}.json").write_text(json.dumps(doc), encoding="utf-8-sig")
    config = files.read_configs(spark, str(tmp_path / "c"))
    who = spark.createDataFrame([("owl", 3), ("owl", 1), ("custom", 0)], "game_type string, version int")
    assert {(r.game_type, r.version, r.fps) for r in files.lookup(config, who, "FPS", "fps").collect()} == {("owl", 3, 2.0), ("owl", 1, 4.5), ("custom", 0, 0.0)}
    (tmp_path / "r.json").write_text('{"left": {"team": "L", "players": ["a", "b", "c", "d", "e", "f"]}, "right": {"players": ["x"]}}')
    r = files.read_roster(spark, str(tmp_path / "r.json")).first()
    assert r.left.players[5] == "f" and r.right.team == "Team Right" and r.right.players[0] == "Player 7"
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "m.zip").write_bytes(files.archive({"metainfo": [{"a": 1}], "frames": []}))
    assert {(x.document, x.json) for x in files.read_archives(spark, str(tmp_path / "z")).collect()} == {("metainfo", '[{"a": 1}]'), ("frames", "[]")}
    rows = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("a", "u1")], "name string, url string")
    assert files.append_new(spark, rows, str(tmp_path / "cat"), "name").count() == 2
    more = spark.createDataFrame([("b", "u2"), ("c", "u3")], "name string, url string")
    assert [x.name for x in files.append_new(spark, more, str(tmp_path / "cat"), "name").collect()] == ["c"]
    files.write_documents({"metainfo": rows}, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs" / "metainfo")).count() == 3
    with pytest.raises(ValueError):
        files.write_documents({"other": rows}, str(tmp_path / "docs"))
    files.write_tables({"sheet1": rows}, str(tmp_path / "tables"), "csv")
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "Orb@Ultimate@q.png").write_bytes(b"x")
    i = files.read_images(spark, str(tmp_path / "i")).first()
    assert (i.name, i.category, i.bind) == ("Orb", "ultimate", "q")


def test_kernels():
    rnd = np.random.default_rng(0)
    image = rnd.integers(0, 255, (40, 50)).astype(float)
    part = image[10:22, 15:30]
    best = k.match_template(image, part, threshold=0.95)
    assert best[0][:4] == (15, 10, 30, 22) and best[0][4] > 0.999
    assert k.match_template(image, np.zeros((90, 9))) == []
    assert k.ncc(part, part * 2 + 5) == pytest.approx(1) and k.ncc(part, np.ones_like(part)) == 0 and k.edge_ncc(part, part) == pytest.approx(1)
    assert k.iou(np.array([0, 200, 200]), np.array([200, 200, 0])) == pytest.approx(1 / 3, abs=1e-5)
    assert k.ssim(image, image) == pytest.approx(1) and k.ssim(image, 255 - image) < 0
    square = np.zeros((30, 30))
    square[5:15, 5:12] = 255
    assert k.hu_distance(square, np.roll(square, 6, 1)) < 1e-6 < k.hu_distance(square, np.eye(30) * 255)
    assert k.hu_distance(square, square * 0.6) < 1e-9  # shapes alone count, above 127
    assert k.nms([(0, 0, 10, 10), (1, 1, 11, 11), (20, 20, 30, 30), (2, 2, 4, 4)], [0.9, 0.95, 0.5, 0.1]) == [1, 2]
    mask = np.zeros((8, 9), bool)
    mask[1:4, 1:4] = mask[4, 4] = mask[6, 7] = True
    assert sorted(k.components(mask)) == [(1, 1, 4, 4, 10), (7, 6, 1, 1, 1)]
    assert k.blobs(mask, 0.1, 1.0) == [(1, 1, 4, 4, 10)]
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    assert k.fill_holes(ring).sum() == 25
    assert k.anchored_groups([0, 5, 9, 11, 30], 10) == [0, 0, 0, 1, 2]
    assert k.first_fit_rows([0, 4, 20, 6, 22], 5) == [0, 0, 1, 0, 1]
    assert k.first_fit_rows([0, 5, 7.4], 5) == [0, 0, 1] and k.first_fit_rows([0, 5, 7], 5) == [0, 0, 0]  # the mean 2.5 is cut to 2
    assert k.linspace(1, 2, 1) == [1] and k.linspace(0, 1, 3) == [0, 0.5, 1]
    assert k.nearest_colour(np.array([10, 10, 10]), [(0, 0, 0), (200, 0, 0)]) == 0 and k.nearest_colour(np.zeros(3), [(5, 0, 0), (0, 5, 0)]) == 1
    assert k.ability_mask(np.pad(np.full((6, 6), 250.0), 20)).any()


def naive_scores(image, template, mask, centred):
    """Template scores place by place."""
    image, template = np.atleast_3d(image), np.atleast_3d(template)
    h, w, c = template.shape
    out = np.zeros((image.shape[0] - h + 1, image.shape[1] - w + 1))
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            top = left = right = 0.0
            for j in range(c):
                a, b = image[y : y + h, x : x + w, j][mask], template[..., j][mask]
                a, b = (a - a.mean(), b - b.mean()) if centred else (a, b)
                top, left, right = top + (a * b).sum(), left + (a * a).sum(), right + (b * b).sum()
            out[y, x] = top / np.sqrt(left * right) if left * right > 0 else 0
    return out


def test_match_scores_against_plain_loops():
    rnd = np.random.default_rng(3)
    for shape, small in (((14, 17), (4, 5)), ((12, 15, 3), (5, 4, 3))):
        image, template = rnd.integers(0, 255, shape).astype(float), rnd.integers(0, 255, small).astype(float)
        for mask in (np.ones(small[:2], bool), rnd.random(small[:2]) < 0.7):
            for centred in (True, False):
                assert np.allclose(k.match_scores(image, template, mask, centred), naive_scores(image, template, mask, centred), atol=1e-6)


def test_ssim_against_plain_loops():
    rnd = np.random.default_rng(4)
    a, b = rnd.integers(0, 255, (2, 12, 13)).astype(float)
    c1, c2, out = (0.01 * 255) ** 2, (0.03 * 255) ** 2, []
    for y in range(6):
        for x in range(7):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            cov = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + c1) * (2 * cov[0, 1] + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (cov[0, 0] + cov[1, 1] + c2)))
    assert k.ssim(a, b) == pytest.approx(np.mean(out))


def test_morphology_resizing_and_edges():
    rnd = np.random.default_rng(5)
    mask = rnd.random((15, 18)) < 0.6
    for h, w in ((1, 4), (2, 2), (3, 3), (2, 5)):
        fits = np.zeros_like(mask)
        for y in range(15 - h + 1):
            for x in range(18 - w + 1):
                if mask[y : y + h, x : x + w].all():
                    fits[y : y + h, x : x + w] = True
        inner = k.opened(np.pad(mask, 6), h, w)[6:-6, 6:-6]
        assert np.array_equal(inner, fits)
    image = rnd.random((12, 20))
    assert np.allclose(k.resize(image, 6, 5), image.reshape(6, 2, 5, 4).mean((1, 3)))
    assert k.resize(image, 24, 40).shape == (24, 40) and np.allclose(k.resize(np.full((5, 5, 3), 7.0), 9, 3), 7)
    step = np.zeros((20, 20))
    step[:, 10:] = 255
    assert k.canny(step, 100, 200).sum(0).argmax() in (9, 10) and not k.canny(np.full((9, 9), 3.0), 100, 200).any()
    assert np.allclose(k.lab(np.array([[[255, 255, 255], [0, 0, 0]]])), [[[255, 128, 128], [0, 128, 128]]], atol=0.6)
    box = np.zeros((40, 100, 3), np.uint8)
    box[12:28, 20:80] = (40, 40, 220)
    lines = k.lines_of(k.horizontal_edges(box, 90))
    assert lines and all(abs(y - 12) <= 2 or abs(y - 28) <= 2 for *_, y in lines)
    assert k.text_density(np.ones((30, 40), bool), (5, 10, 20)) == 1
    blob = np.zeros((20, 20), bool)
    blob[2:6, 2:18] = blob[10, 10] = True
    assert k.blobs(blob, 0.01, 0.5, fill=0.9) == [(2, 2, 16, 4, 64)] and k.blob_mask(blob, 0.01, 0.5, large=1, wide=3).sum() == 0
    assert k.blob_mask(blob, 0.001, 0.5).sum() == 65


def test_suppression_by_image(spark):
    rows = [(i, p, float(x), 0.0, float(x + 10), 10.0, s) for i in range(3) for p, (x, s) in enumerate([(0, 0.5), (1, 0.9), (50, 0.4)])]
    df = spark.createDataFrame(rows, "image int, pos long, x1 double, y1 double, x2 double, y2 double, score double")
    assert {(r.image, r.pos) for r in spatial.suppress(df, ["image"]).collect()} == {(i, p) for i in range(3) for p in (1, 2)}


def wait(q, rows, name, spark):
    for _ in range(60):
        q.processAllAvailable()
        if spark.table(name).count() >= rows:
            break
        time.sleep(0.2)
    q.stop()
    return spark.table(name).collect()


def test_streams_equal_batches(spark, tmp_path):
    # gaps of 10 s stay together, more start anew; late markers move the watermark on
    rows = [("a", s) for s in (0, 10, 20, 40, 41)] + [("b", s) for s in (5, 30)]
    schema = "key string, frame long, ts timestamp"
    shape = spark.createDataFrame([(x, s) for x, s in rows], "key string, frame long").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1000))
    end = spark.createDataFrame([("z", 100000)], "key string, frame long").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1000))
    last = spark.createDataFrame([("y", 200000)], "key string, frame long").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1000))
    shape.coalesce(1).write.parquet(str(tmp_path / "s"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    last.coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    stream = sessions.stream_table(spark, str(tmp_path / "s"), schema)
    q = sessions.session_counts(stream, "key", "ts", "10 seconds", "1 minute").writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    got = sorted((r.key, r.n) for r in wait(q, 5, "sess", spark) if r.key < "y")
    assert got == [("a", 2), ("a", 3), ("b", 1), ("b", 1)]
    q = sessions.dedup_stream(stream, 10).writeStream.format("memory").queryName("dd").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    got = sorted(tuple(r) for r in wait(q, 4, "dd", spark) if r.key < "y")
    assert got == [("a", 0, 20, 3), ("a", 40, 41, 2), ("b", 5, 5, 1), ("b", 30, 30, 1)]
    q = sessions.windowed_counts(stream, "ts", "1 minute", None, "1 minute").writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c3")).start()
    assert {4, 3} <= {r.n for r in wait(q, 2, "win", spark)}


def test_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(t.time_format(F.lit(3725.25))) == "01:02:05.2" and one(t.time_format(F.lit(5.05), compat=True)) == "00:00:05.5"
    assert one(t.hms_to_seconds(F.lit("01:02:03.5"))) == 3723.5 and one(t.hms_to_seconds(F.lit("x"))) is None
    assert one(t.last_stem(F.lit("a.b.png"))) == "a.b" and one(t.stem(F.lit("a.b.png"))) == "a"
    assert one(t.linspace(F.lit(1.0), F.lit(3.0), F.lit(3))) == [1.0, 2.0, 3.0]


def test_no_fights_have_no_mean(spark):
    df = spark.createDataFrame([(1, 1, 5.0, "Suicide", 0, 1)], "match_id long, event_id long, time_s double, action string, subject int, object int")
    s = stats.MatchStats(df)
    assert s.mean_fight().count() == 0 and s.fights().count() == 0 and s.separations().count() == 1 and s.eliminations().count() == 0


def test_runs_are_not_split_by_later_batches(spark, tmp_path):
    """Frames 0 and 5 of a key, each in a batch of its own with another key's between: one run, as in a batch."""
    def put(rows):
        spark.createDataFrame(rows, "key string, frame long").withColumn("ts", F.timestamp_seconds(F.col("frame") + 1000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1)  # files are taken in the order of their times

    for rows in ([("a", 0)], [("b", 3)], [("a", 5), ("b", 30)], [("c", 9000)], [("d", 20000)], [("e", 40000)]):
        put(rows)
    stream = sessions.stream_table(spark, str(tmp_path / "s"), "key string, frame long, ts timestamp")
    q = sessions.dedup_stream(stream, 10, watermark="1 hour").writeStream.format("memory").queryName("dd2").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    got = sorted(tuple(r) for r in wait(q, 4, "dd2", spark) if r.key < "c")
    assert got == [("a", 0, 5, 2), ("b", 3, 3, 1), ("b", 30, 30, 1)]


def test_freeze_stream(spark, tmp_path):
    rows = [("a", 0, "x", True), ("a", 1, "y", False), ("a", 2, "z", True), ("b", 0, "u", False), ("a", 3, "w", False)]
    spark.createDataFrame(rows, "key string, frame long, hero string, is_dead boolean").withColumn("ts", F.timestamp_seconds("frame")).coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = sessions.stream_table(spark, str(tmp_path / "s"), "key string, frame long, hero string, is_dead boolean, ts timestamp")
    q = sessions.freeze_stream(stream).writeStream.format("memory").queryName("ff").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    got = sorted(tuple(r) for r in wait(q, 5, "ff", spark))
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "y"), ("a", 3, "w"), ("b", 0, "u")]


def test_match_statistics(spark):
    """Two fights of a match, by hand: every method of MatchStats."""
    rows = [(1, 1, 5.0, "Eliminate", 0, 7), (1, 2, 8.0, "Eliminate", 0, 8), (1, 3, 9.0, "Resurrect", 10, 8), (1, 4, 40.0, "Eliminate", 7, 0), (1, 5, 41.0, "Suicide", 2, 2)]
    events = spark.createDataFrame(rows, "match_id long, event_id long, time_s double, action string, subject int, object int")
    states = spark.createDataFrame([(1, slot, f, f * 0.5, 10 * f + slot) for slot in (0, 7) for f in range(10)], "match_id long, slot int, frame int, time double, ult_charge int")
    m = stats.MatchStats(events, states)
    assert m.elimination_count().first().kills == 3 and m.elimination_count(6, 50).first().kills == 2
    assert m.more_eliminations(m.eliminations(0, 6), 30, 50).count() == 2
    assert m.death_count().first().deaths == 3 and m.duration().first().duration == 4.5
    assert m.fight_count().first().fights == 2 and m.mean_fight().first().duration == (3 + 7 + 0 + 7) / 2
    assert {(r.fight, tuple(k.event_id for k in r.kills)) for r in m.all_fights().collect()} == {(1, (1, 2)), (2, (4,))}
    assert {r.event_id: r.fight for r in m.fight_index().collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2}
    assert sorted(r.separation for r in m.separations().collect()) == [0.0, 24.0]
    assert m.top_killer().first()[1:] == (0, 2) and tuple(m.top_ratio().first())[1:] == (0, 2.0)
    assert m.state_range(1, 2).count() == 6
    assert {(r.slot, r.delta) for r in m.charge_delta_sum([(0, 3), (5, 9)]).collect()} == {(0, 70), (7, 70)}

"""Frame validity and versions from pixels, held against numpy."""

import numpy as np
from ordwell.operators import validity as v
from ordwell.plans.pixel_queries import VERSIONS

SCHEMA = "match_id int, frame long, width int, data binary, alive boolean"


def plain(image, version):
    x, y, w, h = version.corner
    roi = image[y : y + h, x : x + w].reshape(-1, 3).astype(float)
    return bool(roi.std(0).max() < version.max_std and roi.mean(0).mean() > version.min_mean)


def test_against_numpy(spark):
    rnd = np.random.default_rng(4)
    rows, want, since = [], {}, {}
    for frame in range(240):
        match = frame % 6
        image = np.clip(rnd.normal(135, 12 + 20 * (frame % 3), (4, 5, 3)), 0, 255).astype(np.uint8)
        alive = frame % 5 != 2
        rows.append((match, frame, 5, image.tobytes(), alive))
        want[match, frame] = [x.number for x in VERSIONS if alive and plain(image, x)]
        if want[match, frame]:
            since.setdefault(match, (frame, want[match, frame][0]))
    judged = v.judged(spark.createDataFrame(rows, SCHEMA), VERSIONS[::-1])
    assert {(r.match_id, r.frame): r.valid_under for r in judged.collect()} == want
    assert {r.match_id: (r.since, r.version) for r in v.versions_of(judged).collect()} == since
    assert len({x for _, x in since.values()}) > 1 and any(not x for x in want.values())
    for r in v.validated(judged).collect():
        first, version = since[r.match_id]
        assert r.version == version and r.is_valid == (r.frame >= first and version in want[r.match_id, r.frame])


def test_edges(spark):
    bright = bytes([200]) * 60
    rows = [(1, 0, 5, None, True), (1, 1, 5, b"\xc8" * 9, True), (1, 2, 5, bright, None), (1, 3, 4, bright, True), (1, 4, 5, bright, True), (1, 4, 5, bright, True), (2, 0, 5, b"", True), (None, 0, 5, bright, True)]
    judged = v.judged(spark.createDataFrame(rows, SCHEMA), VERSIONS)
    got = sorted((r.match_id or 0, r.frame, r.valid_under) for r in judged.collect())
    assert [x[2] for x in got] == [[0, 1, 2], [], [], [], [1], [0, 1, 2], [0, 1, 2], []]
    assert sorted((r.match_id or 0, r.since, r.version) for r in v.versions_of(judged).collect()) == [(0, 0, 0), (1, 3, 1)]
    out = v.validated(judged)
    assert out.count() == len(rows) and out.where("is_valid").count() == 3
    assert v.validated(v.judged(spark.createDataFrame([], SCHEMA), VERSIONS)).count() == 0


def test_stays_in_the_jvm(spark):
    plan = v.judged(spark.createDataFrame([], SCHEMA), VERSIONS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan

"""Filters that the frame source takes."""

import json

import numpy as np
import pytest
from ordwell.sources import frames as f
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringStartsWith

JOBS = json.dumps([{"name": "a", "region": [0, 0, 1, 1], "step": 2}, {"name": "b", "region": [0, 0, 0.5, 0.5], "step": 3}])


@pytest.fixture
def video(tmp_path):
    np.save(tmp_path / "v.npy", np.arange(60 * 4 * 4 * 3, dtype=np.uint8).reshape(60, 4, 4, 3))
    return str(tmp_path / "v.npy")


def test_ranges_outside_are_not_planned(video):
    r = f.PushedFrameReader({"path": video, "jobs": JOBS, "workers": "4"})
    odd = StringStartsWith(("job",), "a")
    assert list(r.pushFilters([GreaterThan(("frame",), 40), LessThanOrEqual(("frame",), 50), odd, In(("job",), ("b", "c"))])) == [odd]
    assert min(p.first for p in r.partitions()) == 41 and max(p.after for p in r.partitions()) == 51 and [j["name"] for j in r.jobs] == ["b"]
    assert list(r.pushFilters([EqualTo(("job",), "none")])) == [] and [(p.first, p.after) for p in r.partitions()] == [(0, 0)]


def test_the_same_rows_with_and_without(spark, video):
    spark.dataSource.register(f.FrameSource)
    name = "spark.sql.python.filterPushdown.enabled"
    plain = spark.read.format("ordwell_frames").options(path=video, jobs=JOBS).load()
    want = lambda where: sorted(tuple(r) for r in plain.where(where).collect())
    cases = {w: want(w) for w in ("frame between 10 and 20", "job = 'b' and frame > 30", "job in ('a', 'x')", "frame = 6", "frame > 100", "job = 'none'", "frame < 9 and length(data) > 20")}
    spark.conf.set(name, "true")
    try:
        pushed = spark.read.format("ordwell_frames").options(path=video, jobs=JOBS, pushdown="true").load()
        for where, rows in cases.items():
            assert sorted(tuple(r) for r in pushed.where(where).collect()) == rows, where
    finally:
        spark.conf.unset(name)

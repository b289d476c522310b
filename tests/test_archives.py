"""Archives written by tasks, put in place by one commit."""

import json
import os
import zipfile

import pytest
from ordwell.operators import game
from ordwell.sources import archives, files


def test_archives_are_written_whole_and_read_back(spark, tmp_path):
    rows = [(m, k, f"é {m}.{k}", None if k % 3 else 1.5) for m in range(7) for k in range(50)]
    df = spark.createDataFrame(rows, "match_id long, k int, name string, v double").repartition(5)
    archives.write_archives(archives.rows_of(df, "data_sheet2", "k").unionByName(archives.rows_of(df.where("k < 2"), "frames", "k")), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [f"{m}.zip" for m in range(7)]
    with zipfile.ZipFile(tmp_path / "3.zip") as z:
        assert z.testzip() is None and json.loads(z.read("data_sheet2.json"))[4] == {"k": 4, "name": "é 3.4"}
    got = {(r.path.rsplit("/", 1)[-1], r.document): json.loads(r.json) for r in files.read_archives(spark, str(tmp_path)).collect()}
    assert len(got) == 14 and all([x["k"] for x in v] == list(range(50 if d == "data_sheet2" else 2)) for (_, d), v in got.items())


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(m, m) for m in range(20)], "match_id long, k int")
    rows = archives.rows_of(df.where("k < 19"), "frames", "k").unionByName(archives.rows_of(df.where("k = 19"), "no_such", "k"))
    with pytest.raises(Exception, match="no document named no_such"):
        archives.write_archives(rows, str(tmp_path))
    assert os.listdir(tmp_path) == []
    archives.write_archives(rows.limit(0), str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_a_game_puts_out_its_documents(spark, tmp_path):
    states = [(m, slot, f, f * 0.5, f"x{slot}", False, False, 10) for m in (1, 2) for slot in range(12) for f in range(8)]
    g = game.Game(
        spark.createDataFrame(states, "match_id long, slot int, frame int, time double, hero string, is_dead boolean, is_ult_ready boolean, ult_charge int"),
        spark.createDataFrame([(m, f, f * 0.5, True, False) for m in (1, 2) for f in range(8)], "match_id long, frame int, time double, is_valid boolean, is_replay boolean"),
        spark.createDataFrame([(1, 4, 0, 0, "x2", 1, "x8", False)], "match_id long, frame int, row int, killer_team int, killer string, victim_team int, victim string, is_res boolean"),
    )
    found = g.output(str(tmp_path))
    got = {(r.path.rsplit("/", 1)[-1], r.document): json.loads(r.json) for r in files.read_archives(spark, str(tmp_path)).collect()}
    assert {k: len(v) for k, v in got.items()} == {("1.zip", "frames"): 96, ("1.zip", "data_sheet1"): 1, ("1.zip", "data_sheet2"): 12, ("1.zip", "data_sheet3"): 8, ("2.zip", "frames"): 96, ("2.zip", "data_sheet2"): 12, ("2.zip", "data_sheet3"): 8}
    assert got["1.zip", "data_sheet1"][0]["action"] == "Eliminate" and len(got["2.zip", "data_sheet3"][0]["players"]) == 12
    assert found["lineups"].count() == 24

"""State machines as streams against the same rules over whole series, for any cut into batches."""

import datetime as dt
import os
import random
import time

import pytest
from ordwell.operators import states as s
from ordwell.streaming import batches, folds

SCHEMA = "match_id long, slot int, frame int, ts timestamp, hero string, is_dead boolean, is_ult_ready boolean, ult_charge int, is_down boolean"
RULES = {
    "smooth": (folds.smoothing("hero"), "hero_clean string", ["hero"]),
    "freeze": (folds.freezing("hero", "ult_charge"), "hero_clean string, ult_charge_clean int", ["hero", "ult_charge", "is_dead"]),
    "mech": (folds.mech(2, "h0"), "mech_status int, is_ult_ready_clean boolean, is_secondary_ult_ready boolean", ["hero", "is_ult_ready", "ult_charge", "is_down"]),
}


def made(seed, frames=60):
    rnd, start = random.Random(seed), dt.datetime(2024, 1, 1)
    hero = lambda: rnd.choice(["h0", "h0", "h0", "h1", None])
    return [(1, slot, f, start + dt.timedelta(seconds=f), hero() or "h0", rnd.random() < 0.3, rnd.random() < 0.5, rnd.choice([0, 1, 50, 100]), rnd.random() < 0.1) for slot in range(3) for f in range(frames)]


@pytest.mark.parametrize("rule", RULES)
def test_machines_are_the_rules_over_lists(rule):
    machine, _, _ = RULES[rule]
    for seed in range(20):
        for slot in range(3):
            own = [dict(zip([c.split()[0] for c in SCHEMA.split(", ")], r, strict=True)) for r in made(seed) if r[1] == slot]
            held, got = None, {}
            for r in own:
                held, answered = machine(held, r)
                got.update(answered)
            col = lambda c: [r[c] for r in own]
            if rule == "smooth":
                assert [got[f]["hero_clean"] for f in range(59)] == s.smooth_list(col("hero"))[:59] and 59 not in got
            elif rule == "mech":
                want = zip(*s.mech_states(col("hero"), col("is_ult_ready"), col("ult_charge"), col("is_down"), 2, "h0"), strict=True)
                assert [tuple(got[f].values()) for f in range(60)] == list(want)


@pytest.mark.parametrize("rule, size", [("smooth", 37), ("mech", 100), ("freeze", 60)])
def test_streams_are_the_batch_results(spark, tmp_path, rule, size):
    """Files deal rows in disorder within the watermark's delay; the last row closes the rest."""
    rows = sorted(made(3), key=lambda r: r[2] + random.Random(r[1]).random() * 8)
    rows.append((9, 0, 10_000, dt.datetime(2024, 1, 2), "x", False, False, 0, False))
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for x in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{x}", (time.time() - 10_000 + 5 * k,) * 2)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    machine, results, columns = RULES[rule]
    out = folds.fold_stream(stream, machine, results, columns, watermark="30 seconds")
    batches.run(batches.each_batch(out, f"{tmp_path}/out", lambda df, _: df), spark)
    got = sorted(tuple(r) for r in batches.written(spark, f"{tmp_path}/out", out.schema).collect())
    df = spark.createDataFrame(rows[:-1], SCHEMA)
    names = [r.split()[0] for r in results.split(", ")]
    whole = {"smooth": lambda: s.smooth(df).where("frame < 59"), "freeze": lambda: s.freeze_while_dead(df, "hero", "ult_charge"), "mech": lambda: s.mech_statuses(df, 2, "h0")}[rule]()
    assert got == sorted(tuple(r) for r in whole.select("match_id", "slot", "frame", *names).collect())

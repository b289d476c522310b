"""The passes of a match deal their tables by match and don't shuffle them between passes. F7."""

from ordwell.operators import game
from ordwell.operators import states as s
from ordwell.plans import registry
from ordwell.sources.adapters import player_frames

SF = "/root/testdata/sf0.01"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_folds_take_series_as_dealt(spark):
    states = player_frames(spark, SF)
    assert exchanges(states) == exchanges(s.smooth(states)) == exchanges(s.repaired_charges(states, mech_hero="h0")) == 1


def test_passes_keep_the_deal(spark, monkeypatch):
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n) for n in names}
    real, after = game.cut, []

    def cut(df):
        out = real(df)
        after.append(exchanges(out.groupBy("match_id").count()))
        return out

    monkeypatch.setattr(game, "cut", cut)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        registry.QUERIES["mu7_states"](spark, SF)
        assert after == [0] * 6
        assert spark.conf.get("spark.sql.adaptive.enabled") == before["spark.sql.adaptive.enabled"]
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)

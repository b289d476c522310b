"""Behaviour of clustering, splitting and merging on small literal feeds."""

import random

from pyspark.sql import functions as F

from ordwell.operators import dedup as d

SCHEMA = "match_id long, frame int, row int, player1 struct<team:int,hero:string>, player2 struct<team:int,hero:string>, assists array<struct<team:int,hero:string>>, ability struct<category:string,name:string>, is_critical boolean, is_environmental boolean"
R0, W1, A1, M1 = (0, "Reaper"), (1, "Widowmaker"), (1, "Ana"), (1, "Mercy")


def det(frame, row=0, killer=R0, victim=W1, assists=(), ability=("weapon", "Kiss"), critical=False, env=False, match=1):
    return (match, frame, row, killer, victim, list(assists), ability, critical, env)


def run(spark, rows, window=12):
    out = d.deduplicate(spark.createDataFrame(rows, SCHEMA), window).orderBy("frame", "row").collect()
    return out


def test_repeats_collapse_to_the_first(spark):
    (r,) = run(spark, [det(f, f % 3) for f in range(8)])
    assert (r.frame, r.row, r.n) == (0, 0, 8) and tuple(r.player1) == R0 and tuple(r.ability) == ("weapon", "Kiss")


def test_empty(spark):
    assert run(spark, []) == []


def test_window_bounds(spark):
    assert len(run(spark, [det(0), det(20)])) == 2
    assert len(run(spark, [det(0), det(12)])) == 1
    assert len(run(spark, [det(0), det(13)])) == 2
    assert len(run(spark, [det(0), det(12), det(24)])) == 1


def test_matches_do_not_mix(spark):
    assert len(run(spark, [det(0), det(1, match=2)])) == 2


def test_what_matches(spark):
    assert len(run(spark, [det(0, killer=None), det(1)])) == 1
    assert len(run(spark, [det(0), det(1, killer=(0, "Lucio"))])) == 1
    assert len(run(spark, [det(0), det(1, victim=A1)])) == 2
    assert len(run(spark, [det(0), det(1, killer=M1)])) == 2
    assert len(run(spark, [det(0, killer=M1), det(1, killer=A1)])) == 2
    assert len(run(spark, [det(0), det(1, killer=W1, victim=R0)])) == 2


def test_votes(spark):
    (r,) = run(spark, [det(0, critical=True, env=True), det(1, critical=True), det(2)])
    assert (r.is_critical, r.is_environmental) == (True, False)
    (r,) = run(spark, [det(0, critical=True), det(1)])
    assert r.is_critical is False
    (r,) = run(spark, [det(0, ability=None), det(1), det(2)])
    assert tuple(r.ability) == ("weapon", "Kiss")
    (r,) = run(spark, [det(0, ability=None), det(1, ability=None), det(2)])
    assert r.ability is None
    (r,) = run(spark, [det(0, killer=None), det(1, killer=None), det(2)])
    assert tuple(r.player1) == R0
    (r,) = run(spark, [det(0, killer=None), det(1, killer=None)])
    assert r.player1 is None
    (r,) = run(spark, [det(0, killer=(0, "Lucio")), det(1), det(2)])
    assert tuple(r.player1) == R0
    (r,) = run(spark, [det(0, killer=(0, "Lucio")), det(1)])
    assert tuple(r.player1) == (0, "Lucio")


def test_assists(spark):
    (r,) = run(spark, [det(0, assists=[(0, "Ana"), (0, "Lucio")]), det(1, assists=[(0, "Lucio")]), det(2, assists=[(1, "Lucio")])])
    assert [tuple(a) for a in r.assists] == [(0, "Lucio")]
    (r,) = run(spark, [det(0, assists=[(0, "Ana")]), det(1)])
    assert r.assists == []


def test_resurrection_is_a_barrier(spark):
    rows = [det(0), det(1), det(3, killer=M1), det(4, killer=M1), det(6), det(7)]
    out = run(spark, rows)
    assert [r.frame for r in out] == [0, 3, 6]
    assert len(run(spark, [det(0), det(3, killer=M1), det(3, 1)])) == 2
    assert len(run(spark, [det(0), det(0, 1, killer=M1), det(1)])) == 2


def test_split_of_rows_on_one_screen(spark):
    out = run(spark, [det(0), det(1), det(2), det(2, 1), det(3), det(3, 1)])
    assert [(r.frame, r.row, r.n) for r in out] == [(0, 0, 4), (2, 0, 2)]
    out = run(spark, [det(5, r) for r in range(3)])
    assert [(r.row, r.n) for r in out] == [(0, 1), (1, 1), (2, 1)]


def slow_split(cluster):
    by = {}
    for f, r in cluster:
        by.setdefault(f, []).append(r)
    twice = sorted(f for f, rs in by.items() if len(rs) > 1)
    if not twice:
        return [cluster]
    f, low = twice[0], min(by[twice[0]])
    return slow_split([e for e in cluster if e[0] < f or e[1] > low]) + [[e for e in cluster if e[0] >= f and e[1] == low]]


def test_pieces_equal_recursive_rule():
    rnd = random.Random(0)
    for _ in range(3000):
        cluster = sorted({(rnd.randrange(6), rnd.randrange(5)) for _ in range(rnd.randint(1, 14))})
        got = {}
        for e, p in zip(cluster, d.pieces(*map(list, zip(*cluster, strict=True))), strict=True):
            if p >= 0:
                got.setdefault(p, []).append(e)
        assert sorted(got.values()) == sorted(x for x in slow_split(cluster) if x)


def slow_clusters(rows, window):
    """Components by comparing all pairs."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    res = lambda r: r[3] is not None and r[3][0] == r[4][0]
    bursts = {}
    for r in rows:
        if res(r):
            own = bursts.setdefault((r[3], r[4]), [])
            if own and r[1] - own[-1][1] <= window:
                own[-1][1] = r[1]
            else:
                own.append([r[1], r[1]])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            same = a[4] == b[4] and res(a) == res(b) and (not res(a) or a[3] == b[3])
            between = any(v == a[4] and a[1] < s and e < b[1] for (_, v), own in bursts.items() for s, e in own)
            if b[1] - a[1] <= window and same and not between:
                root[find(j)] = find(i)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), set()).add((r[1], r[2]))
    return sorted(map(sorted, groups.values()))


def test_clusters_equal_pairwise_rule(spark):
    rnd = random.Random(1)
    rows = []
    for m in range(40):
        places = {(rnd.randrange(30), rnd.randrange(6)) for _ in range(rnd.randint(1, 40))}
        rows += [det(f, r, killer=rnd.choice([None, R0, M1, A1]), victim=rnd.choice([W1, R0]), match=m) for f, r in places]
    got = {}
    for r in d.clusters(spark.createDataFrame(rows, SCHEMA), 3).collect():
        got.setdefault((r.match_id, r.player2, r.is_res, r.rescuer, r.cluster), []).append((r.frame, r.row))
    for m in range(40):
        assert sorted(sorted(v) for k, v in got.items() if k[0] == m) == slow_clusters([r for r in rows if r[0] == m], 3)


def test_partitioning_changes_nothing(spark):
    rnd = random.Random(2)
    rows = [det(f, r, victim=rnd.choice([W1, A1]), killer=rnd.choice([R0, M1, None])) for f in range(40) for r in rnd.sample(range(6), 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = [sorted(map(str, d.Detections(df.repartition(n), 3).deduplicate().collect())) for n in (1, 7)]
    assert results[0] == results[1]


def test_order_of_input_changes_nothing(spark):
    rows = [det(f, victim=v) for f in range(6) for v in (W1,)]
    assert [r.n for r in run(spark, rows[::-1])] == [6]
    assert spark.createDataFrame(rows, SCHEMA).where(d.is_resurrection(F.col("player1"), F.col("player2"))).count() == 0


def test_one_key_takes_linear_time(spark):
    """Barriers and gaps in one key: eight times the rows take no more than so many times as long."""
    import time

    from pyspark.sql import functions as F

    def seconds(n):
        p = lambda team, hero: F.struct(F.lit(team).alias("team"), F.lit(hero).alias("hero"))
        df = spark.range(n).select(F.lit(1).alias("match_id"), F.col("id").cast("int").alias("frame"), F.lit(0).alias("row"), F.when(F.col("id") % 50 == 0, p(1, "mercy")).otherwise(p(0, "reaper")).alias("player1"), p(1, "ana").alias("player2"))
        began = time.perf_counter()
        d.clusters(df, 3).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(160_000) < 8 * seconds(20_000) + 3

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordwell.llm import periodic_runs as r


def slow(w):
    """All runs, by trying every period; the least period of each stretch counts."""
    best, n = {}, len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - s >= p and i + p - s >= 12:
                best.setdefault((s, i + p), p)
    return sorted((s, e, p) for (s, e), p in best.items())


def found(texts):
    return r.find_runs([np.array(t, np.int64) for t in texts])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=80), min_size=1, max_size=4))
def test_small_alphabets(texts):
    assert found(texts) == [slow(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_made_of_repetitions(seed):
    """Nested and copied repetitions, some of them inside longer earlier factors."""
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        t = []
        while len(t) < 400:
            kind = rng.random()
            if kind < 0.4 or not t:
                t += [rng.randrange(rng.choice([2, 4, 50]))] * rng.choice([1, 1, 3, 14])
            elif kind < 0.7:
                a = rng.randrange(len(t))
                t += t[a : a + rng.randrange(1, 90)]
            else:
                a = rng.randrange(len(t))
                t += t[a : a + rng.randrange(1, 20)] * rng.randrange(2, 6)
        texts.append(t)
    assert found(texts) == [slow(t) for t in texts]


def test_edges():
    fib = [0, 1]
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    for t in (b, fib, [], [1], [1] * 11, [1] * 12, [1] * 500, [1, 2, 3] * 4, [1, 2, 3] * 4 + [1, 2], [*range(50), *range(50)], [*range(50), *range(49)]):
        assert found([t]) == [slow(t)], t
    assert found([[1] * 12, [1] * 12]) == [[(0, 12, 1)]] * 2  # texts don't run into each other


def test_levels_agree():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 2, 200)
    levels = r.doubling(t, np.full(200, 200))
    i, j = rng.integers(0, 200, 500), rng.integers(0, 200, 500)
    i, j = i[i != j], j[i != j]
    for a, b, f, g in zip(i.tolist(), j.tolist(), r.agree(levels, i, j).tolist(), r.agree_before(levels, i, j).tolist(), strict=True):
        x = next((k for k in range(200) if a + k >= 200 or b + k >= 200 or t[a + k] != t[b + k]), None)
        y = next((k for k in range(201) if a - k < 1 or b - k < 1 or t[a - k - 1] != t[b - k - 1]), None)
        assert (f, g) == (x, y)


def row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow(w)
    dropped = {i for s, e, p in runs for i in range(s + p, e)}
    best = min(((s - e, s, p) for s, e, p in runs), default=None)
    told = (best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in sorted(runs, key=lambda x: (x[0], x[2])))
    return (doc_id, len(runs), *told, sha256(lines.encode()).hexdigest(), sha256(b" ".join(x for i, x in enumerate(w) if i not in dropped)).hexdigest())


def test_query_on_planted_texts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["a", "b", "é", "dd"]) for _ in range(rng.randrange(0, 120))), 1) for k in range(300)]
    rows += [(None, "x " * 40, 1), (None, None, 1), (1, "", 1), (2, "\n\t x  y\r\n", 1), (7, " q" * 30, 1), (7, " q" * 30, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = r.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((row(*x[:2]) for x in rows), key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 6000").collect()
    got = {x.doc_id: tuple(x) for x in r.op13_periodic_runs(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(got[x.doc_id] == row(*x) for x in rows)


def test_columns_long_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d " * 60_000, "kept", 5)], "doc_id long, text string, collapsed string, _text int")
    (x,) = r.periodic_runs(df).collect()
    assert x["_text"] == 5 and x.collapsed == "a b c d" and [tuple(v) for v in x.runs] == [(0, 240_000, 4)]
    assert r.periodic_runs(df.limit(0)).count() == 0

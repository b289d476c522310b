import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ordwell.llm import simhash


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = sorted({p for _, p in rows})
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    ids = {}
    for d, p in rows:
        if d is not None:
            ids[find(p)] = min(d, ids.get(find(p), d))
    return {(d, p, ids.get(find(p))) for d, p in rows}


def test_fingerprint_matches_plain_count():
    rnd = random.Random(3)
    texts = ["", " \n", "One", "a B", "x y z", "é ÉA b\x0bc", " ".join(rnd.choice("abcdefg") for _ in range(3000)), "w " * 70000]
    for t in texts:
        assert simhash.fingerprint_of(t.encode()) == slow_print(t)
        assert simhash.fingerprint_of(t.encode(), block=7 if len(t) < 10000 else 1 << 15) == slow_print(t)


def test_parts_cover_all_bits():
    masks = simhash.parts_of(0)
    assert len(masks) == 3 and sum(masks) == (1 << 64) - 1
    for m in masks:
        deeper = simhash.parts_of(m)
        assert all(d & m == m for d in deeper) and sum(d ^ m for d in deeper) == ((1 << 64) - 1) ^ m


def test_join_tries_finds_all_pairs():
    rnd = random.Random(5)
    centres = [rnd.getrandbits(64) for _ in range(20)]
    group = lambda: sorted({c ^ (1 << rnd.randrange(64)) * rnd.randint(0, 1) ^ (1 << rnd.randrange(8)) for c in centres for _ in range(15)})
    groups = [group() for _ in range(3)] + [[7]]
    prints = np.array([x for g in groups for x in g], np.uint64)
    bounds = np.cumsum([0] + [len(g) for g in groups])
    got = {(min(a, b), max(a, b)) for a, b in zip(*map(np.ndarray.tolist, simhash.join_tries(prints, bounds)), strict=True)}
    want = set()
    for k, g in enumerate(groups):
        want |= {(bounds[k] + j, bounds[k] + i) for i, a in enumerate(g) for j, b in enumerate(g[:i]) if (a ^ b).bit_count() <= 2}
    assert got == want


def test_components_match_brute_force(spark):
    rnd = random.Random(9)
    base = [" ".join(rnd.choice("abcdefghijklmnop") + rnd.choice("xyz") for _ in range(rnd.randint(1, 300))) for _ in range(25)]
    rows = []
    for i in range(260):
        words = rnd.choice(base).split()
        if rnd.random() < 0.7 and len(words) > 5:
            words[rnd.randrange(len(words))] = "new"
        rows.append((rnd.choice([i, i, i, None]), " ".join(words), "x"))
    rows += [(500, None, "x"), (501, "", "x"), (502, "  \n", "x"), (3, rows[0][1], "x"), (3, rows[0][1], "x"), (None, "a lone text", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, print string")
    want = slow_components([(d, slow_print(t)) for d, t, _ in rows])
    for crowd in (2048, 3):
        found = simhash.near_duplicates(spark, df, crowd=crowd).collect()
        assert len(found) == len(rows)
        assert {(r.doc_id, r.print % (1 << 64), r.component_id) for r in found} == want
        kept = simhash.keep_one(spark, df, crowd=crowd)
        assert kept.columns == df.columns
        assert kept.count() == len({r.root for r in found})


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(spark, df).count() == 0
    assert simhash.keep_one(spark, df).count() == 0


def test_hex(spark):
    assert spark.range(1).select(simhash.as_hex(F.lit(-1)), simhash.as_hex(F.lit(26))).first()[:] == ("f" * 16, "000000000000001a")


def similar(a, b, shingle=5):
    x, y = (set(simhash.shingles_of((t or "").encode(), shingle).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similarity_against_plain_sets(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(60)] + [None, "", "A b  C d\ne f", "a b c d e f", "x " * 50_000]
    pairs = [(rnd.choice(texts), rnd.choice(texts)) for _ in range(300)]

    def plain(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", simhash.hashes_of(F.col("a"), 5).alias("x"), simhash.hashes_of(F.col("b"), 5).alias("y")).collect():
        x, y = plain(r.a), plain(r.b)
        j = len(x & y) / len(x | y) if x | y else 1.0
        sets = [np.frombuffer(v, np.uint64) for v in (r.x, r.y)]
        assert all(simhash.alike(*sets, s) == (j >= s) for s in (0.0, 0.1, 0.3, 0.5, 0.8, 1.0))


def test_similar_texts_go_and_others_stay(spark):
    """Each text that goes is similar to a smaller one; of planted copies at 0.8 and more nearly all go; all kept ones differ."""
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, planted = [], []
    for k in range(60):
        base = [word() for _ in range(rnd.randint(60, 200))]
        rows.append((1000 * k, " ".join(base)))
        for j in range(1, rnd.randint(2, 12)):
            copy = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 60))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((1000 * k + j, " ".join(copy)))
            planted.append(rows[-1][0])
    rows += [(None, rows[0][1]), (5, rows[3][1].upper()), (90001, None), (90002, ""), (90003, "one two"), (90004, "one two"), (90005, "one three")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, similar_key int").repartition(5)
    out = simhash.drop_similar(spark, df)
    assert out.columns == df.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    near = lambda r: [q for q in ordered[: ordered.index(r)] if similar(q[1], r[1]) >= 0.8]
    should = [r for r in rows if near(r)]
    went = [r for r in rows if r not in kept]
    same_words = lambda r: any(q != r and (q[1] or "").lower().split() == (r[1] or "").lower().split() for q in rows)
    assert all(near(r) for r in went)
    missed = [r for r in should if r in kept and not same_words(r)]
    assert len(missed) <= 0.06 * len(should) and len(should) > 200
    assert (90003, "one two") in kept and (90005, "one three") in kept


def test_large_groups_of_unlike_texts(spark, monkeypatch):
    """All texts share all keys, but few are similar: each is held against few, copies of the first go, the plan doesn't grow."""
    monkeypatch.setattr(simhash, "signature", lambda text, shingle: F.struct(F.xxhash64(text).alias("key"), F.array(F.lit(1).cast("long")).alias("bands")))
    rows = [(k, " ".join(f"{k % 4}w{i}" for i in range(40)) + (" end" if k > 11 else "")) for k in range(24)]
    got = {r.text for r in simhash.drop_similar(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first = {t for k, t in rows if k < 12}
    assert first == got  # each copy has its original among the pivots
    assert simhash.drop_similar(spark, spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


@pytest.mark.parametrize("groups, size, most", [(1, 400, 6), (40, 10, 4)])
def test_recall_on_groups_at_the_limit(spark, groups, size, most):
    """Texts of 150 words with 0 to `most` words changed: pairs lie on either side of 0.8. Against all pairs."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for g in range(groups):
        base = [word() for _ in range(150)]
        for j in range(size):
            copy = list(base)
            for _ in range(rnd.randint(0, most)):
                copy[rnd.randrange(150)] = word()
            rows.append((g * size + j, " ".join(copy)))
    rows = list({t: (i, t) for i, t in reversed(rows)}.values())[::-1]  # texts with the same words are one
    kept = {r.doc_id for r in simhash.drop_similar(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = {i: set(simhash.shingles_of(t.encode(), 5).tolist()) for i, t in rows}
    own = lambda i: [j for j in range(i // size * size, i) if j in sets]
    should = {i for i in sets if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in own(i))}
    went = {i for i, _ in rows} - kept
    assert went <= should and len(should) > 130
    assert len(went) >= 0.9 * len(should), (len(went), len(should))


def test_similar_texts_beyond_the_pivots_meet(spark, monkeypatch):
    """One group of 130 texts, all unlike, then a near copy of each: originals lie past the pivots, every copy goes. F2."""
    monkeypatch.setattr(simhash, "signature", lambda text, shingle: F.struct(F.xxhash64(text).alias("key"), F.array(F.lit(1).cast("long")).alias("bands")))
    monkeypatch.setattr(simhash, "BLOCK", 20)
    base = [(k, " ".join(f"{k}w{i}" for i in range(40))) for k in range(130)]
    rows = base + [(1000 + k, t + " end") for k, t in base]
    kept = {r.doc_id for r in simhash.drop_similar(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == {k for k, _ in base}

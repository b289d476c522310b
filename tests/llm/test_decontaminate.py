import random
import re

import corpus_pipeline
from ordwell.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1) if m else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), sorted(found - {None})


def cases():
    rnd = random.Random(4)
    vocabulary = ["a", "b", "é", "x1", "Zz"]
    items = [(str(k), " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 9)))) for k in range(14)]
    items += [("20", "solo"), ("21", "solo"), ("22", "..."), ("100", items[1][1])]
    texts = [" ".join(rnd.choice(vocabulary) + rnd.choice([".", " ", "-"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    return items, [*texts, None, "", "solo", "SOLO solo", "\n"]


def test_scan_matches_brute_force():
    items, texts = cases()
    for window in (1, 2, 4, 13):
        machines = d.machines([(i, t.encode()) for i, t in items], window)
        for t in texts:
            n, spans, found = d.scan(machines, t and t.encode())
            assert (n, sum(b - a for a, b in spans), found) == slow(t, items, window)


def test_moves_skip_words():
    machine = d.WuManber(13, {tuple(b"p%d" % i for i in range(13)): ["1"]})
    assert machine.furthest == 12
    assert not list(machine.search([b"q"] * 1000))
    assert list(machine.search([b"q"] * 5 + [b"p%d" % i for i in range(13)])) == [(5, ["1"])]


def test_blocks_of_items_give_the_same(spark):
    items, texts = cases()
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, "solo", 0)], "doc_id long, text string, hits_0 int")
    bench = spark.createDataFrame([*items, (None, "b b"), ("5", None)], "item_id string, text string")
    for size in (16 << 20, 200):
        found = d.find_contamination(docs, bench, window=4, block_bytes=size)
        assert found.columns == ["doc_id", "text", "hits_0", "hits"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("search(") == plan.count("ArrowEvalPython") == 1
        for r in found.collect():
            assert (r.hits.n_words, r.hits.n_hit, r.hits["items"]) == slow(r.text, [*items, (None, "b b")], 4)


def test_items_without_an_id_are_hit(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, "another text"), (3, "solo")], "doc_id long, text string")
    spark.createDataFrame([(None, passage), (None, "solo"), (7, "solo"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.benchmark_stage(spark, docs, str(tmp_path)).collect()] == [2]
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    for size in (16 << 20, 40):
        found = {r.doc_id: r.hits for r in d.find_contamination(docs, bench, block_bytes=size).collect()}
        assert {k: (h.n_hit, h["items"]) for k, h in found.items()} == {1: (14, []), 2: (0, []), 3: (1, ["7"])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    r = d.find_contamination(docs, bench).select("hits.*", d.contaminated(d.F.col("hits")).alias("c")).first()
    assert (r.n_words, r.n_hit, r["items"], r.c) == (2, 0, [], False)
    assert d.find_contamination(docs.limit(0), bench).count() == 0


def test_one_block_at_a_time(spark, monkeypatch):
    """However many blocks the benchmark has, one search at a time is planned, and each block is bounded."""
    items, texts = cases()
    bench = spark.createDataFrame([*items, ("long", " ".join(f"w{k}" for k in range(3000)))], "item_id string, text string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, " ".join(f"w{k}" for k in range(2900, 2950))])], "doc_id long, text string")
    monkeypatch.setattr(d, "PIECE", 100)
    sizes, real = [], d.hits
    monkeypatch.setattr(d, "hits", lambda text, own, window: (sizes.append(sum(len(t) + 32 for _, t in own)), real(text, own, window))[1])
    found = d.find_contamination(docs, bench, window=4, block_bytes=3000)
    assert len(sizes) > 4 and max(sizes) < 4 * 3000
    got = {r.doc_id: r.hits for r in found.collect()}
    assert got[len(texts)]["items"] == ["long"] and got[len(texts)].n_hit == 50
    for k, t in enumerate(texts):
        assert (got[k].n_words, got[k].n_hit, got[k]["items"]) == slow(t, items, 4)


def test_very_long_text_repeats_and_clash(spark):
    passage = " ".join(f"p{k}" for k in range(13))
    text = "filler " * 200_000 + passage + " filler" * 100_000
    docs = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, passage, 7)], "doc_id long, text string, Hits int")
    bench = spark.createDataFrame([(3, passage), (3, passage), (4, passage.upper() + " more")], "item_id long, text string")
    got = d.find_contamination(docs, bench)
    assert got.columns == ["doc_id", "text", "hits"]
    assert [(r.hits.n_hit, r.hits["items"]) for r in got.collect()] == [(13, ["3", "4"])] * 3

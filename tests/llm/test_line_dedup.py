import random

import corpus_pipeline
from ordwell.llm import line_dedup as d


def slow(rows, least):
    """Texts after deletion, by comparing all runs of lines with at least `least` words; for each run its first place stays."""
    docs = []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        docs.append((doc, text, [(i, " ".join(x.lower().split())) for i, x in enumerate((text or "").split("\n")) if x.split()]))
    seen, gone = {}, {}
    for doc, text, own in docs:
        for a in range(len(own)):
            for z in range(a, len(own)):
                run = own[a : z + 1]
                if sum(len(t.split()) for _, t in run) >= least:
                    low = seen.setdefault(tuple(t for _, t in run), (doc, text, a))
                    if low[:2] != (doc, text) or a > low[2] + z - a:
                        gone.setdefault((doc, text), set()).update(i for i, _ in run)
    return {(doc, None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get((doc, text), ()))) for doc, text in rows}


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    pool = [" ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 14]))) for _ in range(10)]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 14)))) for k in range(80)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1].upper()), (None, rows[4][1]), (5, rows[5][1]), (204, "\n\n"), (205, "z z\n" * 40)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, gone int")
    for least in (1, 7, 12):
        got = d.drop_repeated_lines(spark, df, least=least, removed="n")
        assert got.columns == [*df.columns, "n"]
        out = [(r.doc_id, r.text) for r in got.collect()]
        assert len(out) == len(rows) and set(out) == slow(rows, least)


def test_first_run_stays_where_it_overlaps_its_repetition(spark):
    """Of twelve equal lines of ten words the first five, a run of fifty, stay; no content is lost elsewhere either."""
    line = " ".join(f"w{k}" for k in range(10))
    rows = [(1, "\n".join([line] * 12)), (2, "\n".join([line] * 6))]
    got = {r.doc_id: (r.text, r.Gone) for r in d.drop_repeated_lines(spark, spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, gone int"), removed="Gone").collect()}
    assert got == {1: ("\n".join([line] * 5), 7), 2: ("", 6)}


def test_hot_runs_and_very_long_texts(spark):
    """A run that most rows have (more than a thousandth of all places), and a text of 20,000 lines."""
    run = [f"shared line {k} with some more words in it" for k in range(8)]
    rows = [(k, "\n".join([f"own {k} one", *run, f"own {k} two"])) for k in range(1500)]
    rows += [(5000, "\n".join(f"line {k} of the long text" for k in range(20_000))), (5001, "\n".join(f"line {k} of the long text" for k in range(100, 19_000)))]
    got = {r.doc_id: r.text for r in d.drop_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1] and all(got[k] == f"own {k} one\nown {k} two" for k in range(1, 1500))
    assert got[5000] == rows[-2][1] and got[5001] == ""


def test_stage_deletes_ends_of_runs(spark):
    line = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    runs = {0: [line("a", 120), line("b", 10), line("c", 10)], 10: [line("d", 30), line("e", 25), line("f", 20)]}
    # the run of 21 and 22 goes on past that of 20, where its first window stands first
    more = [(20, [line("g", 60), line("h", 5)]), (21, [line("g", 60), line("i", 5)]), (22, ["own", line("g", 60), line("i", 5), "end"])]
    rows = [(k + j, "\n".join(["top %d" % (k + j), *run, "tail %d" % (k + j)])) for k, run in runs.items() for j in (0, 1)] + [(k, "\n".join(x)) for k, x in more]
    df = spark.createDataFrame([(a, b, "en", "s", 0) for a, b in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert got == {**dict(rows), 1: "top 1\ntail 1", 11: "top 11\ntail 11", 21: line("i", 5), 22: "own\nend"}


def test_windows():
    assert d.windows_of([5, 3, 9], [4, 4, 4], 8) == [(3, 1, 0, 1), (3, 1, 1, 2)]
    assert d.windows_of([5, 5], [9, 2], 8) == [(5, 0, 0, 0)]
    assert d.windows_of([], [], 8) == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.drop_repeated_lines(spark, df, removed="n").columns == ["doc_id", "text", "n"]
    assert d.drop_repeated_lines(spark, df).count() == 0

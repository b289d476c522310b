import random
import re
from collections import defaultdict

from ordwell.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def slow(rows, fewest, most, share, left, copies=False):
    lines, texts = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in x)))
    for k, (_, t, host) in enumerate(rows):
        own = k if copies else t
        texts[host].add(own)
        for x in (t or "").split("\n"):
            if norm(x):
                lines[host, norm(x)].add(own)
    out = []
    for doc, text, host in rows:
        t = text or ""
        w = WORD.findall(t)
        seen = defaultdict(list)
        for i in range(len(w) - 2):
            seen[tuple(w[i : i + 3])].append(i)
        again = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(norm(x).split(" ")) for x in full if len(lines[host, norm(x)]) > max(fewest, min(most, share * len(texts[host]))))
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        out.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again), failed, not failed and len(w) - gone >= left * len(w), gone))
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(8)
    pool = [" ".join(rnd.choice(["a", "bé", "c#", "D", "<e>", "f", "g\tg", "h  h", "中"]) for _ in range(rnd.randint(0, 12))) for _ in range(25)]
    rows = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25))), rnd.choice(["h1", "h1", "h2", None])) for k in range(120)]
    rows += [(3, rows[3][1], rows[3][2]), (None, None, "h1"), (901, "", None), (902, " \n\x0b\r\n", "h2"), (903, "one two", "h2"), (904, "x y z " * 4000, "h2"), (905, " ".join(map(str, range(60))), "h9")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, source string, host int, counted int, Kept int, n_symbols int")
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    key = lambda r: tuple((x is None, x) for x in r)
    for fewest, most, share, left, copies in ((3, 50, 0.05, 0.5, False), (3, 4, 0.2, 0.5, False), (3, 50, 0.05, 0.5, True)):
        got = q.judge(spark, df, fewest=fewest, most=most, share=share, left=left, copies=copies)
        assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(slow(rows, fewest, most, share, left, copies), key=key)
        assert got.columns == ["doc_id", "source", "host", "counted", *q.RESULTS]
        rows_got = got.collect()
        assert any(r.kept for r in rows_got) and any(not r.kept and not r.base_failed for r in rows_got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert q.judge(spark, df).count() == 0


def test_query_rejects_depleted_documents(spark):
    got = q.op2_quality(spark, "/root/testdata/sf0.01").where("not base_failed and not kept").collect()
    assert got and all(5 * r.n_removed_words > r.n_words for r in got)

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ordwell.llm import language_id as l

WORDS = {"aa": ["kala", "kirja", "talo", "metsä"], "bb": ["strom", "glück", "wasser", "und"], "cc": ["вода", "дом", "лес"]}


def texts(n, seed):
    rnd = random.Random(seed)
    return [(k, " ".join(rnd.choice(WORDS[x]) for _ in range(rnd.randint(3, 40))), x) for k in range(n) for x in [rnd.choice(list(WORDS))]]


def brute(text):
    """n-grams of a text, character by character."""
    flat = re.sub("[^\\W\\d_]|.", lambda m: m[0] if m[0].isalpha() else " ", f" {text.lower()} ", flags=re.S)
    flat = re.sub(" +", " ", flat)
    return Counter(flat[i : i + l.N] for i in range(len(flat) - l.N + 1))


def hashed(gram):
    return int(l.grams([np.array([ord(c) for c in gram], np.uint64)])[0][0])


def test_grams_match_brute_force_for_any_piece():
    rnd = random.Random(3)
    every = ["Abc def", "", "x", "ABC, DEF!", "  a  b  ", "ΑΣ ΑΣΑ. İx", "12ab--c"] + ["".join(rnd.choice("abé Д.-\n1") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    for piece in (1, 2, 3, 7, 1 << 20):
        parts = [(i, c) for i, t in enumerate(every) for c in l.codes_of(t, piece)]
        h, a, b = l.grams([c for _, c in parts])
        got = [Counter() for _ in every]
        for (i, _), x, y in zip(parts, a.tolist(), b.tolist(), strict=True):
            got[i].update(h[x:y].tolist())
        assert got == [Counter({hashed(g): n for g, n in brute(t).items()}) for t in every]


def test_counts_match_brute_force(monkeypatch):
    """Hits in the filters, less the false ones, are those of plain sets; whatever the pieces, and for more than 64 languages."""
    rnd = random.Random(4)
    words = {f"l{k:03d}": ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(12)] for k in range(90)}
    known = {x: {g for w in own for g in brute(w)} for x, own in words.items()}
    f = l.Filters(list(words), [np.array([hashed(g) for g in known[x]], np.uint64) for x in words])
    every = [" ".join(rnd.choice(words[x]) for _ in range(rnd.randint(1, 30))) for x in words]
    counts = f.counts(every)
    for piece in (3, 50):
        monkeypatch.setattr(l, "PIECE", piece)
        assert np.array_equal(f.counts(every), counts)
    for i, t in enumerate(every):
        own = brute(t)
        assert counts[i, 0] == own.total()
        for k, x in enumerate(words):
            true = sum(n for g, n in own.items() if g in known[x])
            assert true <= counts[i, k + 1] <= true + 0.2 * own.total() + 3
    assert f.decide(every)[0] == list(words)


def test_filter_returns_all_languages_of_a_gram():
    known = [np.arange(0, 900, dtype=np.uint64) ** 3, np.arange(500, 1200, dtype=np.uint64) ** 3]
    f = l.Filters(["x", "y"], known)
    assert all(f.masks(known[0])[0] & 1) and all(f.masks(known[1])[0] & 2)
    other = np.arange(5000, 9000, dtype=np.uint64) ** 3
    assert abs(np.mean(f.masks(other)[0] & 1 > 0) - f.false[0]) < 0.02


def test_identify(spark):
    rows = [(*r, 1) for r in texts(400, 1)] + [(900, None, "aa", 1), (901, "", "aa", 1), (902, "123 !?", None, 1), (None, "wasser und strom", "bb", 1), (903, "Kala talo " * 30000, None, 1), (904, "und wasser", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted_ int")
    got = l.identify(spark, df).collect()
    assert len(got) == len(rows)
    for r in got:
        if not r.text or r.doc_id == 902:
            assert (r.predicted.lang, r.predicted.score) == ("und", 0.0)
        else:
            assert 0 <= r.predicted.score <= 1
            assert r.predicted.lang == (r.lang or {903: "aa", 904: "bb"}[r.doc_id])
    assert df.select(l.accepted(l.F.struct(l.F.lit("und").alias("lang"), l.F.lit(1.0).alias("score"))).alias("a")).first().a is False


def test_labels_of_held_out_rows_are_not_used(spark):
    df = spark.createDataFrame(texts(300, 2), "doc_id long, text string, lang string")
    wrong = df.withColumn("lang", l.F.when(l.held_out(l.F.col("doc_id")), "zz").otherwise(l.F.col("lang")))
    assert {r.predicted.lang for r in l.identify(spark, wrong).collect()} == set(WORDS)


def test_sample_is_bounded(spark):
    df = spark.createDataFrame(texts(600, 3), "doc_id long, text string, lang string")
    counts = l.sample(df, "doc_id", "lang", 50).groupBy("lang").count().collect()
    assert all(0 < r["count"] <= 50 for r in counts) and len(counts) == 3


def test_sample_is_full_beyond_one_bucket(spark):
    many = spark.range(12000).select("id", F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") < 4, "bb").otherwise("aa").alias("lang"))
    one = spark.range(400).select(F.lit(-1).cast("long").alias("id"), F.concat(F.lit("u"), "id").alias("text"), F.lit("cc").alias("lang"))
    same = spark.range(300).select(F.lit(-2).cast("long").alias("id"), F.lit("v").alias("text"), F.lit("dd").alias("lang"))
    rare = spark.range(4000).select("id", F.lit("w").alias("text"), F.lit("dd").alias("lang"))
    df = many.union(one).union(same).union(rare)
    for per_language in (1, 5, 70):
        rows = l.sample(df, "id", "lang", per_language).collect()
        counts = {x: sum(r.lang == x for r in rows) for x in ("aa", "bb", "cc", "dd")}
        assert counts == {"aa": per_language, "bb": min(4, per_language), "cc": per_language, "dd": per_language}
        assert len({(r.id, r.text) for r in rows if r.lang in ("aa", "cc")}) == 2 * per_language
        first = df.where("lang = 'aa'").select(F.pmod(F.xxhash64("id"), F.lit(1024)).alias("b")).orderBy("b").limit(per_language).collect()[-1].b
        bucket = {r.id: r.b for r in df.where("lang = 'aa'").select("id", F.pmod(F.xxhash64("id"), F.lit(1024)).alias("b")).collect()}
        assert all(bucket[r.id] <= first for r in rows if r.lang == "aa")


def test_large_language_is_learned(spark):
    df = spark.range(12000).select("id", F.lit("wasser und strom").alias("text"), F.lit("bb").alias("lang"))
    assert l.learn(spark, df, "id", per_language=2).languages == ["bb"]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert l.identify(spark, df).first().predicted.lang == "und"
    assert l.identify(spark, df.limit(0)).count() == 0


def test_millions_of_rows_of_a_language(spark):
    """Far more rows of a language than its sample times the buckets, with the usual sample size."""
    df = spark.range(3_000_000).select("id", F.concat(F.lit("wasser und strom "), "id").alias("text"), F.lit("bb").alias("lang"))
    assert l.sample(df, "id", "lang", l.PER_LANGUAGE).count() == l.PER_LANGUAGE


def test_held_out_accuracy(spark):
    got = l.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.where("lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)


def test_result_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([(*r, 1) for r in texts(50, 7)], "doc_id long, text string, lang string, predicted int")
    assert l.identify(spark, df).columns == df.columns

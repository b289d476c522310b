from pyspark.sql import functions as F

from ordwell.llm import url_filter as u


def test_rules_and_list(spark):
    urls = [
        (1, "http://a.com/x"), (2, "http://com/"), (3, "http://Example.com/en/1?q"), (4, "https://www.EXAMPLE.com/en/"), (5, "http://x.www.example.com/en/2"),
        (6, "ftp://h.net/es/"), (7, "http://net/fr/x#y"), (8, "http://net/fr"), (9, None), (10, "no scheme/net/es/"), (11, "http://notexample.com/en/"), (12, "http://a.com"),
        (13, "http://www.bad.org/p/?utm_source=f"), (14, "https://bad.org/p"), (15, "http://bad.org/p?x=1"), (16, "http://bad.org/P"), (17, "://"), (17, "http://h.net/es/\n?"), (18, "a://b://c.com/d"),
    ]
    df = spark.createDataFrame([(a, b, "k") for a, b in urls], "page_id long, url string, canonical_url string").selectExpr("*", "9 AS rule", "8 AS Host", "7 AS key")
    listing = spark.createDataFrame([("http://bad.org/p/#top",), ("http://bad.org/p",), (None,), ("junk",)], "url string")
    judged = u.judge_urls(spark, df, listing)
    assert judged.columns == ["page_id", "url", "canonical_url", "key", "host", "path", "rule", "verdict"]
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in judged.collect()}
    assert len(got) == len(urls)
    assert got[1, "a.com"] == ("/x", "com/", "allow")
    assert got[2, "com"] == ("/", "com/", "allow")
    assert got[3, "example.com"] == ("/en/1", "example.com/en/", "block")
    assert got[4, "www.example.com"] == ("/en/", "www.example.com/en/", "allow")
    assert got[5, "x.www.example.com"][1:] == ("www.example.com/en/", "allow")
    assert got[6, "h.net"][1:] == ("net/es/", "block")
    assert got[7, "net"] == ("/fr/x", "net/fr/", "block")
    assert got[8, "net"] == ("/fr", None, "allow")
    assert got[9, ""] == got[10, ""] == ("", None, "allow")
    assert got[11, "notexample.com"][1:] == ("com/", "allow")
    assert got[12, "a.com"] == ("", None, "allow")
    assert got[13, "www.bad.org"][2] == got[14, "bad.org"][2] == "block"
    assert got[15, "bad.org"][2] == got[16, "bad.org"][2] == got[17, ""][2] == "allow"
    assert got[17, "h.net"] == ("/es/\n", "net/es/", "block")
    assert got[18, "b:"][0] == "//c.com/d"


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(4000).selectExpr("concat('h', id) AS key")
    df = spark.range(8000).selectExpr("concat('h', id) AS k")
    for most in (u.MOST_BYTES, 0):
        u.MOST_BYTES, old = most, u.MOST_BYTES
        found = u.listed(spark, df, "k", keys, "hit").collect()
        u.MOST_BYTES = old
        assert {r.k for r in found if r.hit} == {f"h{i}" for i in range(4000)} and len(found) == 8000


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "url string")
    assert u.judge_urls(spark, pages, none).first().verdict == "allow"
    assert u.judge_urls(spark, pages.limit(0), none).count() == 0


def test_filter_has_false_hits_that_the_join_removes(spark):
    """Some keys pass the filter though they aren't listed; the exact join alone keeps them out."""
    keys = spark.range(20000).selectExpr("concat('h', id) AS key")
    blocks = -(-20000 * u.BITS_PER_KEY // 64)
    bloom = keys.groupBy(u.block_of(F.col("key"), blocks).alias("b")).agg(F.bit_or(u.bits_of(F.col("key"))).alias("m"))
    others = spark.range(20000, 60000).selectExpr("concat('h', id) AS key").select("key", u.block_of(F.col("key"), blocks).alias("b"), u.bits_of(F.col("key")).alias("o"))
    falsely = others.join(bloom, "b").where(F.col("m").bitwiseAND(F.col("o")) == F.col("o")).select("key").collect()
    assert 0 < len(falsely) < 0.03 * 40000
    probe = spark.createDataFrame([(r.key,) for r in falsely], "k string")
    assert not any(r.hit for r in u.listed(spark, probe, "k", keys, "hit").collect())


def test_query_is_decided_by_rules_and_by_the_list(spark):
    got = u.op8_url_filter(spark, "/root/testdata/sf0.01").groupBy(F.col("rule").isNull().alias("by_list"), "verdict").count().collect()
    assert {(r[0], r.verdict) for r in got} == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def test_long_urls(spark):
    long = "http://h.org/" + "a" * 200_000
    pages = spark.createDataFrame([(1, long), (2, long + "b"), (None, long)], "page_id long, url string")
    got = u.judge_urls(spark, pages, spark.createDataFrame([(long + "#x",)], "url string")).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "block"), (1, "block"), (2, "allow")]

"""Operator 2 (native): quality rules with cross-document line frequency.

Base rules look at one text: words, symbols, repeated lines and repeated three-word
windows. The method looks across texts: lines are normalised (A-Z lower-cased, white
space collapsed) and hashed; for each host (the column source) the distinct documents
that have a line are counted. A line is taken out where more documents have it than the
host's limit: SHARE of its documents, but FEWEST at least and MOST at most, so neither
small hosts lose lines to chance nor large ones keep boilerplate. A document of whose
words less than LEFT remain is depleted and rejected. Exact copies are one document, so
copies of a clean text don't condemn it; with `copies` each row counts. All of it is
DataFrame expressions.

One pass over the texts writes counts and line hashes to the shared folder; everything
after reads those. Null and empty texts have no words and fail the base rules. A null
host is a host of its own. Rows may repeat and ids may be null: rows are told apart by
a number written with them. Lines and windows of three words are compared by 64-bit
hashes. Very long texts are worked on whole. Columns of df pass through, but for those
named like a result, which the result replaces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.common import ascii_lower, fresh, settle, table

MIN_WORDS = 50
FEWEST = 5
MOST = 20
SHARE = 0.005
LEFT = 0.8
WHITE = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """body(value), with value worked out once for each row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def repeated(w: Column) -> Column:
    """Words of w that lie in three-word windows found twice or more."""

    def among(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twin = lambda s: F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == e["h"])))
        places = let(pairs, lambda s: F.sort_array(F.transform(twin(s), lambda e: e["i"])))
        gaps = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(3), lambda n, k: n + F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, gaps))

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, among))


def normal_lines(text: Column, host: Column) -> Column:
    """(hash of host and normalised line, words) of each line that has a word."""
    flat = F.translate(ascii_lower(text), "\t\x0b\x0c\r", "    ")
    tidy = lambda x: let(F.trim(x), lambda t: F.when(F.instr(t, "  ") > 0, F.regexp_replace(t, " +", " ")).otherwise(t))
    lines = F.filter(F.transform(F.split(flat, "\n"), tidy), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(host, x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n")))


def measures(text: Column) -> dict[str, Column]:
    """The base rules' counts for a text."""
    t = F.coalesce(text, F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, f"{WHITE} ", "")) > 0)
    both = let(words(t), lambda w: F.struct(F.size(w).alias("n"), repeated(w).alias("r")))
    return {
        "counted": both,
        "word_chars": F.length(F.translate(t, f"{WHITE} ", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")


def judge(spark: SparkSession, df: DataFrame, text: str = "text", host: str = "source", fewest: int = FEWEST, most: int = MOST, share: float = SHARE, left: float = LEFT, copies: bool = False) -> DataFrame:
    """df (without text) with the base counts, n_removed_words, base_failed and kept."""
    passed = [c for c in df.columns if c != text and c.lower() not in RESULTS]
    own_names = ("row", "document", "lines", "host", "counted", "line", "host_name", "limit", "row_hit")
    row, document, lines, own, counted, line, host_name, limit, row_hit = fresh(df.select(*passed).withColumns({c: F.lit(0) for c in RESULTS}), *own_names)
    found = measures(F.col(text))
    number = F.monotonically_increasing_id()
    m = df.select(
        *passed,
        number.alias(row),
        (number if copies else F.xxhash64(text)).alias(document),
        F.col(host).alias(own),
        F.coalesce(normal_lines(F.col(text), F.col(host)), F.array()).alias(lines),
        found.pop("counted").alias(counted),
        *(c.alias(k) for k, c in found.items()),
    )
    m = settle(spark, m)
    each = m.select(row, document, own, F.explode(lines).alias(line)).select(row, document, own, F.col(f"{line}.h").alias(line), F.col(f"{line}.n").alias("n"))
    having = each.groupBy(line, own, document).agg(F.lit(1).alias("one")).groupBy(line, own).agg(F.count("*").alias("having"))
    bound = F.greatest(F.lit(fewest), F.least(F.lit(most), share * F.count("*")))
    hosts = m.groupBy(own, document).agg(F.lit(1).alias("one")).groupBy(F.col(own).alias(host_name)).agg(bound.alias(limit))
    often = having.where(F.col("having") > fewest).join(hosts, F.col(own).eqNullSafe(F.col(host_name))).where(F.col("having") > F.col(limit)).select(line)
    removed = each.select(row, line, "n").join(often, line).groupBy(F.col(row).alias(row_hit)).agg(F.sum("n").cast("long").alias("n_removed_words"))
    n, r, gone = F.col("n_words"), F.col("n_repeat_words"), F.col("n_removed_words")
    failed = (n < MIN_WORDS) | (100 * r > 50 * n)
    return (
        m.drop(lines, document, own)
        .join(removed, F.col(row) == F.col(row_hit), "left")
        .withColumns({"n_words": F.col(f"{counted}.n").cast("long"), "n_repeat_words": F.col(f"{counted}.r").cast("long"), "n_removed_words": F.coalesce(gone, F.lit(0)).cast("long")})
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (n - gone >= left * n))
        .select(*passed, *RESULTS)
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(spark, docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT r, i, (w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (
  SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
k AS (
  SELECT l.r, d.source, d.text, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM l JOIN d USING (r) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
h AS (SELECT source, count(DISTINCT text) AS n FROM d GROUP BY source),
f AS (SELECT source, w, count(DISTINCT text) AS n FROM k GROUP BY source, w),
o AS (SELECT f.source, f.w FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > greatest(5, least(20, 0.005 * h.n))),
gone AS (SELECT k.r, sum(len(k.w)) AS n FROM k JOIN o ON k.w = o.w AND k.source IS NOT DISTINCT FROM o.source GROUP BY k.r),
b AS (
  SELECT d.r, d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.8 * n_words AS kept,
  n_removed_words
FROM b
"""

QUERIES = {"op2_quality": op2_quality}
ORACLES = {"op2_quality": OP2_SQL}

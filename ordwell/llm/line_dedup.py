"""Operator 9: removal of repeated runs of lines, found by winnowing.

Lines with a word are normalised (A-Z lower-cased, white space collapsed) and hashed.
At each line a window starts that takes as many lines as reach `least` words; of each
window the smallest line hash is selected. Two texts that share a run of at least that
many words share a whole window, and so what it selects: a guaranteed fingerprint.
Fingerprints found at two places or more are joined by their hash. Around each of their
places runs grow both ways: to the left to every line from which a window reaches the
place, to the right line by line from that window's end to where the next line's window
ends (what is longer consists of that and of the next line's runs). So the longest
matches are covered, and there are at most as many such runs as lines, besides the
windows. A run's hash meets those of all places at once, so no pairs are made.

A run is deleted where it stands later than its first place (by id, then text hash, then
line): in another document, or in the same one after the first place's end. So of lines
that overlap with their own repetition the first run stays whole.

Null texts and texts without words stay as they are. Null ids come first. Rows with
the same id and text count as one document, so neither is later than the other. Very
long lines and texts are hashed whole. Other columns pass through; an empty table
gives none. A fingerprint or run that very many places have isn't brought together in
one task: its places are reduced before the shuffle and looked up in a bounded table.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ordwell.llm.common import forget, fresh, join_by_weight, release, settle, table

LEAST = 50
LINES = "struct<at: array<int>, hash: array<long>, words: array<int>>"


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def lines_of(text: Column) -> Column:
    """Line numbers, hashes and word counts of the lines of text that have words."""

    @F.arrow_udf(LINES)
    def split(texts: pa.Array) -> pa.Array:
        at, hashes, words, ends = array("i"), array("q"), array("i"), array("i", [0])
        for one in (x.as_py() for x in texts.cast(pa.large_binary())):
            for i, line in enumerate((one or b"").lower().split(b"\n")):
                if parts := line.split():
                    at.append(i)
                    hashes.append(signed(xxh64_intdigest(b" ".join(parts))))
                    words.append(len(parts))
            ends.append(len(at))
        release()
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(flat(ends), flat(v)) for v in (at, hashes, words)], ["at", "hash", "words"])

    return split(text)


def flat(values: array) -> pa.Array:
    """An array's memory as an Arrow array."""
    return pa.array(np.frombuffer(values, values.typecode) if len(values) else np.empty(0, values.typecode))


def each(lists: pa.ListArray) -> Iterator[list]:
    """The lists, one after the other; few Python objects at a time."""
    bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return (values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def windows_of(hashes: list[int], words: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(selected hash, its place, first, last) of the window at each line, where least words follow."""
    out, last, total = [], -1, 0
    for first in range(len(hashes)):
        while total < least and last + 1 < len(hashes):
            last += 1
            total += words[last]
        if total < least:
            break
        place = min(range(first, last + 1), key=lambda k: (hashes[k], -k))
        out.append((hashes[place], place, first, last))
        total -= words[first]
    return out


def winnow(lines: Column, least: int) -> Column:
    """Column of the selected (hash, place), each once."""

    @F.arrow_udf("array<struct<pick: long, place: int>>")
    def select(found: pa.Array) -> pa.Array:
        _, hashes, words = found.flatten()
        picks, places, ends = array("q"), array("i"), array("i", [0])
        for h, w in zip(each(hashes), each(words), strict=True):
            for pick, place in sorted({x[:2] for x in windows_of(h, w, least)}):
                picks.append(pick)
                places.append(place)
            ends.append(len(picks))
        release()
        return pa.ListArray.from_arrays(flat(ends), pa.StructArray.from_arrays([flat(picks), flat(places)], ["pick", "place"]))

    return select(lines)


def runs_of(windows: list[tuple[int, int, int, int]], lines: int) -> list[tuple[int, int, int]]:
    """(place, first, last) of the runs that grow from the windows, each up to where the next line's window ends."""
    stops = [last for *_, last in windows[1:]] + [lines]
    return [(k, a, e) for (_, k, a, z), stop in zip(windows, stops, strict=False) for e in range(z, max(z + 1, stop))]


def extend(lines: Column, places: Column, least: int) -> Column:
    """Column of the runs around the given places: first and last line and the hash of all their lines."""

    @F.arrow_udf("array<struct<first: int, last: int, run: long>>")
    def around(found: pa.Array, at: pa.Array) -> pa.Array:
        _, hashes, words = found.flatten()
        first, last, run, ends = array("i"), array("i"), array("q"), array("i", [0])
        for h, w, own in zip(each(hashes), each(words), each(at), strict=True):
            packed, own = struct.pack(f"<{len(h)}q", *h), set(own)
            for k, a, e in runs_of(windows_of(h, w, least), len(h)):
                if k in own:
                    first.append(a)
                    last.append(e)
                    run.append(signed(xxh64_intdigest(packed[8 * a : 8 * e + 8])))
            ends.append(len(run))
        release()
        return pa.ListArray.from_arrays(flat(ends), pa.StructArray.from_arrays([flat(first), flat(last), flat(run)], ["first", "last", "run"]))

    return around(lines, places)


def first_places(spark: SparkSession, rows: DataFrame, key: str) -> DataFrame:
    """For each key with two places (column where) or more: the first, and how many rows have it; reduced before the shuffle."""
    groups = rows.groupBy(key).agg(F.min("where").alias("low"), F.max("where").alias("high"), F.count("*").alias("n"))
    return settle(spark, groups.where("low <> high").select(key, "low", "n"))


def repeated_lines(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, gone): the numbers of the lines to delete, for texts that have any. key: struct of id and text hash."""
    key = F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash"))
    lines = settle(spark, df.select(key.alias("key"), lines_of(F.col(text)).alias("lines")).where("size(lines.at) > 0"))
    picks = settle(spark, lines.select("key", F.explode(winnow(F.col("lines"), least)).alias("p")).select("p.pick", F.struct("key", "p.place").alias("where")))
    shared = first_places(spark, picks, "pick")
    places = join_by_weight(picks, shared.select("pick", "n"), "pick", "n", picks.count(), "left_semi").groupBy("where.key").agg(F.collect_set("where.place").alias("places"))
    around = lines.dropDuplicates(["key"]).join(places, "key").select("key", F.col("lines.at").alias("at"), F.explode(extend(F.col("lines"), F.col("places"), least)).alias("w"))
    around = settle(spark, around.select(F.expr("slice(at, w.first + 1, w.last - w.first + 1)").alias("at"), "w.run", F.struct("key", "w.first").alias("where")))
    first = first_places(spark, around, "run")
    again = join_by_weight(around, first, "run", "n", around.count())
    later = again.where("where.key <> low.key or where.first >= low.first + size(at)")
    gone = settle(spark, later.groupBy("where.key").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone")))
    forget(spark, lines, picks, shared, around, first)
    return gone


def drop_repeated_lines(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, removed: str | None = None) -> DataFrame:
    """df without the lines of later repeated runs. removed: name of a column for their number."""
    gone = repeated_lines(spark, df, doc_id, text, least)
    key, k, g, n = fresh(df, "line_key", "gone_key", "gone", "n_gone")
    shown = df.withColumn(key, F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("hash")))
    gone = gone.select(F.col("key").alias(k), F.col("gone").alias(g))
    joined = shown.join(gone.hint("merge"), F.col(key) == F.col(k), "left")  # as many rows as documents that lose lines: no bound
    rest = F.expr(f"transform(array_except(sequence(0, size(split(`{text}`, '\\n')) - 1), `{g}`), i -> i)")
    both = F.transform(F.array(F.struct(F.split(F.col(text), "\n").alias("l"), rest.alias("r"))), lambda x: F.array_join(F.transform(x["r"], lambda i: F.get(x["l"], i)), "\n"))[0]
    out = joined.withColumn(n, F.coalesce(F.size(g), F.lit(0)).cast("long")).withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(both))
    held = [c for c in df.columns if not removed or c.lower() != removed.lower()]
    return out.select(*held, *([F.col(n).alias(removed)] if removed else []))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from every document, and a digest of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(spark, docs, removed="n_removed").select(
        "doc_id",
        "n_removed",
        F.length("text").cast("long").alias("n_chars_left"),
        F.md5("text").alias("text_md5"),
    )


OP9_SQL = """
WITH l AS (
  SELECT doc_id, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)),
w AS (
  SELECT doc_id, i, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM l),
n AS (
  SELECT doc_id, i, row_number() OVER o AS k, array_to_string(w, ' ') AS t, sum(len(w)) OVER o AS upto, len(w) AS n
  FROM w WHERE len(w) > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
z AS (
  SELECT a.doc_id, a.k AS first, min(b.k) AS z
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= 50 GROUP BY ALL),
c AS (SELECT doc_id, max(k) AS lines FROM n GROUP BY doc_id),
e AS (
  SELECT doc_id, first, unnest(generate_series(z, greatest(z, coalesce(stop - 1, lines)))) AS last
  FROM (SELECT z.*, lines, lead(z) OVER (PARTITION BY doc_id ORDER BY first) AS stop FROM z JOIN c USING (doc_id))),
r AS (
  SELECT e.doc_id, e.first, e.last, string_agg(n.t, chr(10) ORDER BY n.k) AS run
  FROM e JOIN n ON n.doc_id = e.doc_id AND n.k BETWEEN e.first AND e.last GROUP BY ALL),
f AS (SELECT *, first_value(doc_id) OVER o AS low_id, first_value(first) OVER o AS low FROM r WINDOW o AS (PARTITION BY run ORDER BY doc_id, first)),
gone AS (
  SELECT DISTINCT n.doc_id, n.i FROM f JOIN n ON n.doc_id = f.doc_id AND n.k BETWEEN f.first AND f.last
  WHERE f.doc_id <> f.low_id OR f.first > f.low + f.last - f.first),
out AS (
  SELECT l.doc_id, count(gone.i) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS t
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(CASE WHEN d.text IS NOT NULL THEN length(coalesce(t, '')) END AS BIGINT) AS n_chars_left,
       CASE WHEN d.text IS NOT NULL THEN md5(coalesce(t, '')) END AS text_md5
FROM documents d LEFT JOIN out ON out.doc_id = d.doc_id
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": OP9_SQL}

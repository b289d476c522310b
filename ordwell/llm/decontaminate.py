"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of 13 consecutive words of every benchmark item (all words
of a shorter item). For each pattern length m a table gives, for the block of words
at the end of the search window, how far the window may move on: m - 1 for blocks
that no pattern has. Where the move is zero, the block's bucket holds the patterns
that end in it; their first block is compared, then all of their words.

Null texts have no words; items without words match nothing; items that share windows
are all named; ids are compared as strings; repeated items and rows change nothing. The
windows of items whose id is null count as hits, only their names are missing from items.
Very long texts are searched whole. A column named like the result is replaced by it.

The benchmark is cut into pieces of bounded length that share windows' beginnings, so no
window is lost, and the pieces are dealt into blocks of about block_bytes by a hash.
One block at a time comes to the driver and to the workers, which search all texts for
it; what it hits is written to the shared folder, by a digest of the text, before the
next is fetched. The last block, mostly the only one, is searched where the result is
made, and joined with what the others hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.common import forget, fresh, release, settle, table

WINDOW = 13
PIECE = 4096  # windows
BLOCK_BYTES = 16 << 20
#: A-Z lower-cased; ASCII that is neither letter nor digit becomes a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
HITS = "struct<n_words: long, spans: array<struct<first: int, after: int>>, items: array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORDS).split()


class WuManber:
    """Search for word sequences that are all m words long."""

    def __init__(self, m: int, patterns: dict[tuple, list[str]]):
        self.m, self.block = m, min(2, m)
        self.furthest = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list] = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, m + 1):
                at = words[end - self.block : end]
                self.shift[at] = min(self.shift.get(at, self.furthest), m - end)
            self.bucket[words[-self.block :]].append((words[: self.block], words, items))

    def search(self, words: list[bytes]):
        """(position, items) of every occurrence, in order."""
        m, block, n, get, furthest = self.m, self.block, len(words), self.shift.get, self.furthest
        end = m
        while end <= n:
            last = tuple(words[end - block : end])
            move = get(last, furthest)
            if move:
                end += move
                continue
            start = end - m
            first, here = tuple(words[start : start + block]), None
            for prefix, pattern, items in self.bucket[last]:
                if prefix == first and (here := here or tuple(words[start:end])) == pattern:
                    yield start, items
            end += 1


def machines(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    """One search for each pattern length among (id, text)."""
    by_length: dict[int, dict[tuple, list[str]]] = defaultdict(lambda: defaultdict(list))
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1) if m else ():
            known = by_length[m][tuple(words[i : i + m])]
            if item not in known[-1:]:
                known.append(item)
    return [WuManber(m, patterns) for m, patterns in sorted(by_length.items())]


def scan(searches: list[WuManber], text: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
    """Words of a text, the stretches that patterns cover, and the items found."""
    words = words_of(text)
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for s in searches:
        for start, own in s.search(words):
            found.append((start, start + s.m))
            items.update(own)
    spans: list[list[int]] = []
    for start, end in sorted(found):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return len(words), [tuple(x) for x in spans], sorted(items - {None})


def hits(text: Column, items: list[tuple[str, bytes]], window: int = WINDOW) -> Column:
    """Words, covered stretches and items of text, for one block of items."""
    made: list = []

    @F.arrow_udf(HITS)
    def search(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(machines(items, window))
        rows = [scan(made[0], x) for x in texts.cast(pa.large_binary()).to_pylist()]
        release()
        spans = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[{"first": a, "after": b} for a, b in r[1]] for r in rows], spans),
                pa.array([r[2] for r in rows], pa.list_(pa.string())),
            ],
            ["n_words", "spans", "items"],
        )

    return search(text)


def covered(spans: Column) -> Column:
    """Words that stretches cover, where these may overlap."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["after"] - F.greatest(acc["end"], x["first"]))).alias("n"),
        F.greatest(acc["end"], x["after"]).alias("end"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"]).cast("long")


def pieces(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(i, t): the items' ids as strings and pieces of their words, each with all words of its windows."""

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t"), strict=True):
                words = words_of(t.as_py())
                for k in range(0, max(1, len(words) - window + 1), PIECE) if words else ():
                    ids.append(i)
                    texts.append(b" ".join(words[k : k + PIECE + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], ["i", "t"])

    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.encode(F.col(text), "utf-8").alias("t")).where("t is not null")
    return rows.mapInArrow(cut, "i string, t binary").distinct()


def blocks_of(rows: DataFrame, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """(whether it is the last, its pieces) for each block, fetched when asked for."""
    size = rows.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield k == n - 1, sorted(((r.i, bytes(r.t)) for r in own.toLocalIterator()), key=lambda x: (x[0] or "", x[0] is not None, x[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", to: str = "hits", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column to: n_words, spans (word positions that items' windows cover), n_hit and items."""
    spark, digest = docs.sparkSession, F.md5(F.encode(F.col(text), "utf-8"))
    rows = settle(spark, pieces(benchmark, item, item_text, window))
    before: list[DataFrame] = []
    for last, items in blocks_of(rows, block_bytes):
        if last:
            break
        found = docs.where(F.col(text).isNotNull()).select(digest.alias("digest"), hits(F.col(text), items, window).alias("h"))
        before.append(settle(spark, found.where(F.size("h.spans") > 0).dropDuplicates(["digest"])))
    forget(spark, rows)
    now, key, other, spans, names = fresh(docs, "hits_now", "text_digest", "other_digest", "spans_before", "items_before")
    shown = docs.withColumn(now, hits(F.col(text), items, window))
    if before:
        every = before[0]
        for b in before[1:]:
            every = every.union(b)
        gathered = every.groupBy("digest").agg(F.flatten(F.collect_list("h.spans")).alias("s"), F.flatten(F.collect_list("h.items")).alias("n"))
        gathered = settle(spark, gathered)
        forget(spark, *before)
        shown = shown.withColumn(key, digest).join(gathered.select(F.col("digest").alias(other), F.col("s").alias(spans), F.col("n").alias(names)), F.col(key) == F.col(other), "left")
        both = lambda mine, theirs: F.concat(F.col(f"{now}.{mine}"), F.coalesce(F.col(theirs), F.array()))
        all_spans, all_items = both("spans", spans), F.array_sort(F.array_distinct(both("items", names)))
    else:
        all_spans, all_items = F.col(f"{now}.spans"), F.col(f"{now}.items")
    made = F.struct(F.col(f"{now}.n_words"), all_spans.alias("spans"), covered(all_spans).alias("n_hit"), all_items.alias("items"))
    return shown.select(*(c for c in docs.columns if c.lower() != to.lower()), made.alias(to))


def contaminated(hits: Column) -> Column:
    """At least a twentieth of the words are hit."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    h = F.col("hits")
    return found.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"),
        contaminated(h).alias("contaminated"),
    )


OP7_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
      FROM (SELECT item_id, w, least(13, len(w)) AS m, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM p),
g AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
      FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT g.r, g.i, g.m, p.item_id FROM g JOIN p ON g.m = p.m AND g.g = p.g),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + m - 1)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON c.r = d.r LEFT JOIN t ON t.r = d.r
"""

QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLES = {"op7_decontaminate": OP7_SQL}

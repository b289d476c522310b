"""Operator 13: all runs of words (maximal periodic stretches), from suffix arrays.

Words of a batch of texts become numbers, and all texts of the batch are worked on side by
side. Names of stretches of 1, 2, 4 ... words are found by doubling until every suffix has
a name of its own; the last names are the suffix array, and together they tell how far two
places agree, forwards and backwards. Of each suffix the nearest ones before and after it
in the array that begin earlier in the text, and their common prefixes, give the longest
previous factor, and those give the blocks of the LZ factorisation.

A run that touches a block's bound is found there: its period is less than the two blocks
beside it are long, and the extensions from the bound to both sides, a period apart, give
its ends. A run inside a block is one inside the block's earlier occurrence, moved; those
are copied, block by block, from buckets by start. So every run is found, with work that
grows with the words times the logarithm of their number.

Texts without two equal stretches of six words have no run of LEAST words and stop early
(a run agrees with itself, a period on, over half its length). The rest of the batch goes on.

Words are what bytes.split() gives. Null and empty texts have no words, no runs and an empty
collapsed text. A text may be very long: a worker holds one such text with some 300 bytes a
word. Repeated rows each get their own result; results replace columns of their names, other
columns pass through; an empty table gives none.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm.common import release, table

#: Least words of a run, and what two places a period apart then share at least.
LEAST, SHARED = 12, 6
#: Words that are worked on together, where texts aren't longer.
TOGETHER = 200_000

Run = tuple[int, int, int]


def group_starts(new: np.ndarray) -> np.ndarray:
    """For a sorted array's flags of new values: the place where each one's group begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def doubling(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the stretches of 1, 2, 4 ... words at each place, until all differ; ends: where each place's text ends.

    Equal ranks mean equal stretches. keys differ between texts. One more place at the end equals none.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    starts = group_starts(new)
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = starts
    single = new & np.append(new[1:], True)
    active, levels, h = order[~single], [rank], 1
    while len(active):
        after = active + h
        second = np.where(after < ends[active], rank[np.minimum(after, n)] + 1, 0)
        key = rank[active].astype(np.int64) * (n + 2) + second
        o = np.argsort(key, kind="stable")
        active, key = active[o], key[o]
        old = rank[active]
        first = np.ones(len(active), bool)
        first[1:] = old[1:] != old[:-1]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[active] = old + group_starts(new) - group_starts(first)
        levels.append(rank)
        active, h = active[~(new & np.append(new[1:], True))], 2 * h
    return levels


def agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from i and from j on are equal; i and j differ."""
    i, j, begun = i.copy(), j.copy(), i
    for k in reversed(range(len(levels))):
        step = (levels[k][i] == levels[k][j]).astype(np.int64) << k
        i += step
        j += step
    return i - begun


def agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before i and before j are equal."""
    i, j, begun = i.copy(), j.copy(), i
    for k in reversed(range(len(levels))):
        a, b = i - (1 << k), j - (1 << k)
        step = ((a >= 0) & (b >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
        i -= step
        j -= step
    return begun - i


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest place before and after each with a smaller value; -1 where none is. values are distinct."""
    n = len(values)
    tables, k = [values], 0
    while 2 << k <= n:
        t = tables[-1]
        tables.append(np.minimum(t[: n - (2 << k) + 1], t[1 << k : n - (1 << k) + 1]))
        k += 1
    left, right = np.arange(n), np.arange(1, n + 1)
    for k in reversed(range(len(tables))):
        t, a = tables[k], left - (1 << k)
        left = np.where((a >= 0) & (t[np.clip(a, 0, len(t) - 1)] > values), a, left)
        inside = right + (1 << k) <= n
        right = np.where(inside & (t[np.clip(right, 0, len(t) - 1)] > values), right + (1 << k), right)
    return left - 1, np.where(right < n, right, -1)


def previous_factors(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """At each place the longest factor that also begins earlier in its text, and where."""
    rank = levels[-1][:-1]
    places = np.empty(len(rank), np.int64)
    places[rank] = np.arange(len(rank))
    length, source = np.zeros(len(rank), np.int64), np.full(len(rank), -1)
    for near in nearest_smaller(places):
        has = near >= 0
        own, other = places[has], places[near[has]]
        found = agree(levels, own, other)
        better = found > length[own]
        length[own[better]], source[own[better]] = found[better], other[better]
    return length, source


def blocks(length: list[int], start: int, end: int) -> list[int]:
    """Where the blocks of a text's factorisation begin, and its end."""
    out, at = [], start
    while at < end:
        out.append(at)
        at += length[at] or 1
    return [*out, end]


def at_bounds(levels: list[np.ndarray], bounds: list[list[int]]) -> np.ndarray:
    """Rows (start, end, period) of the runs that touch a block's bound, in texts of given blocks; each once, with its least period."""
    c, reach, low, high = [], [], [], []
    for b in bounds:
        c += b[1:]
        sizes = [z - a for a, z in zip(b, b[1:], strict=False)]
        reach += [x + y - 1 for x, y in zip(sizes, [*sizes[1:], 0], strict=True)]
        low += [b[0]] * len(sizes)
        high += [b[-1]] * len(sizes)
    c, low, high = (np.array(x, np.int64) for x in (c, low, high))
    reach = np.minimum(np.array(reach, np.int64), (high - low) // 2)
    which = np.repeat(np.arange(len(c)), reach)
    period = np.arange(len(which)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    found = []
    for sign in (0, -1):  # the place a period after the bound, or before it, against the bound
        i = c[which] + sign * period
        j = i + period
        ok = (i >= low[which]) & (j <= high[which])
        i, j, p = i[ok], j[ok], period[ok]
        two = levels[min(1, len(levels) - 1)]
        near = (two[i] == two[j]) | (i >= 2) & (two[i - 2] == two[j - 2])  # of SHARED words two stand on one side
        i, j, p = i[near], j[near], p[near]
        before, after = agree_before(levels, i, j), agree(levels, i, j)
        good = (before + after >= p) & (before + after + p >= LEAST)
        found.append(np.stack([i - before, j + after, p], axis=1)[good])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def copied(runs: list[Run], bounds: list[int], source: np.ndarray) -> list[Run]:
    """runs of a text and those inside its blocks, from the blocks' earlier occurrences."""
    by_start = defaultdict(list)
    for s, e, p in runs:
        by_start[s].append((e, p))
    for b, z in zip(bounds, bounds[1:], strict=False):
        if z - b < LEAST + 2:
            continue
        back = b - int(source[b])
        for s in range(b + 1, z - LEAST):
            for e, p in by_start.get(s - back, ()):
                if e + back < z:
                    by_start[s].append((e + back, p))
    return sorted((s, e, p) for s, held in by_start.items() for e, p in held)


def with_equal_stretches(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The texts that may have two equal stretches of SHARED words, by a hash; starts has one more, the end."""
    n = len(ids) - SHARED + 1
    if n < 1:
        return np.empty(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    h = np.zeros(n, np.uint64)
    for k in range(SHARED):
        h = (h ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = text[:n] == text[SHARED - 1 :]
    h = ((h ^ text[:n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93))[inside]
    order = np.argsort(h)
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    return np.unique(text[:n][inside][order[same]])


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """All runs (start, end, period) of each text of word numbers, by start and period."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    some = with_equal_stretches(np.concatenate([np.empty(0, np.int64), *texts]), starts)
    if not len(some):
        return out
    sizes = sizes[some]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.concatenate([texts[k] for k in some])
    text = np.repeat(np.arange(len(some)), sizes)
    levels = doubling(text * (ids.max() + 1) + ids, np.repeat(starts[1:], sizes))
    length, source = previous_factors(levels)
    steps = length.tolist()
    bounds = [blocks(steps, a, z) for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    touching = at_bounds(levels, bounds)
    of = np.searchsorted(starts, touching[:, 0], side="right") - 1
    cuts = np.searchsorted(of, np.arange(len(some) + 1))
    for k, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if z > a:
            first = int(starts[k])
            out[some[k]] = [(s - first, e - first, p) for s, e, p in copied(list(map(tuple, touching[a:z].tolist())), bounds[k], source)]
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Flags of the n words that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, e, p in runs:
        change[s + p] += 1
        change[e] -= 1
    return np.cumsum(change[:-1]) == 0


def analysed(texts: list[bytes]) -> list[tuple[list[Run], bytes]]:
    """Each text's runs, and its words without what they repeat."""
    words = [t.split() for t in texts]
    numbers: dict[bytes, int] = {}
    for own in words:
        numbers.update(dict.fromkeys(own))
    for k, w in enumerate(numbers):
        numbers[w] = k
    runs = find_runs([np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)) for own in words])
    return [(r, b" ".join([own[k] for k in np.flatnonzero(kept_words(len(own), r))] if r else own)) for own, r in zip(words, runs, strict=True)]


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic(text: Column) -> Column:
    """Struct (runs, collapsed): all runs by start and period, and the text's words without repetitions, joined by blanks."""

    @F.arrow_udf(f"struct<runs: {RUNS}, collapsed: string>")
    def find(texts: pa.Array) -> pa.Array:
        runs: list[Run] = []
        ends, out = [0], []

        def work(few: list[bytes]) -> None:
            for r, left in analysed(few):
                runs.extend(r)
                ends.append(len(runs))
                out.append(left)

        few, size = [], 0
        for x in texts.cast(pa.large_binary()):
            raw = x.as_py() or b""
            if few and size + len(raw) > 6 * TOGETHER:
                work(few)
                few, size = [], 0
            few.append(raw)
            size += len(raw)
        if few:
            work(few)
        table_ = np.array(runs, np.int64).reshape(-1, 3)
        columns = [pa.array(table_[:, 0]), pa.array(table_[:, 1] - table_[:, 0]), pa.array(table_[:, 2])]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
        result = pa.StructArray.from_arrays([lists, pa.array(out, pa.binary()).cast(pa.string())], ["runs", "collapsed"])
        release()
        return result

    return find(text)


def periodic_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """df with the runs of column text, and the text without their repetitions."""
    both = "_" + max(df.columns, key=len)  # no column has this name
    found = df.withColumn(both, periodic(F.col(text)))
    return found.withColumns({runs: F.col(f"{both}.runs"), collapsed: F.col(f"{both}.collapsed")}).drop(both)


WORD = "([^\\x20\\x09-\\x0D]+)"


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where 10 divides the checksum of the id, the words from some place on repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(1)))
    chosen = chosen.withColumn("words", words).withColumn("n", F.size("words")).withColumn("g", F.expr("h div 10"))
    chosen = chosen.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    chosen = chosen.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p as int) + 1)), 1, n - a))")
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of runs, the longest, and digests of all runs and of the collapsed text of every document."""
    found = periodic_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n"))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    milli = F.when(F.col("best").isNotNull(), F.expr("1000 * best.length div -best.period"))
    return told.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: All runs of a text are beyond SQL; tests hold them to a search over all periods.
ORACLES: dict[str, str] = {}

"""Operator 1: SimHash near-duplicates by a self-join of binary tries.

Distinct fingerprints form a trie. Two nodes of it are visited together, down to pairs
of fingerprints; differing bits add up, and a pair of nodes is left as soon as they
exceed the budget. Spread over a cluster, the order of bits is turned so that each of
three equal parts comes first once: with at most two differing bits one part has none,
so only a trie node paired with itself need be followed through it. All fingerprints
under such a node meet in one task. Nodes with more than `crowd` fingerprints are split
by the same rule on their remaining bits, up to a depth where so few bits are left that
distinct fingerprints bound the node's size. Links of a task are reduced to a spanning
forest; components then follow over the whole graph.

Null and empty texts, and those without words, have fingerprint zero and link like any
other. Null ids never are the smallest; a component of null ids alone has a null id.
Repeated rows share fingerprints; very long texts are hashed in blocks; other columns
may have any names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from ordwell.llm.common import forget, fresh, join_by_weight, release, settle, table
from ordwell.llm.components import components

BITS = 64
BUDGET = 2
CROWD = 2048
DEPTH = 4
SHINGLE = 3
SEED = 42


def fingerprint_of(text: bytes, shingle: int = SHINGLE, block: int = 1 << 15) -> int:
    """The SimHash of one text; a bit is set if it is in over half of the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(size) - 1
    starts = (stops - size + 1).tolist()
    ends = stops[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    total = np.zeros(BITS, np.int64)
    for i in range(0, n, block):
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(starts[i : i + block], ends[i : i + block], strict=False)])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8)).view(np.uint64).reshape(-1, 8)
        lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # 64 counters of a byte each
        total += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def simhash(text: Column) -> Column:
    """SimHash of text as a long."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        made = np.array([fingerprint_of(x.as_py() or b"") for x in texts.cast(pa.large_binary())], np.uint64)
        release()
        return pa.array(made.view(np.int64), pa.int64())

    return fingerprints(text)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def parts_of(mask: int, parts: int = BUDGET + 1) -> list[int]:
    """The masks that fix one more of the equal parts of the bits that mask leaves open."""
    open_bits = [b for b in reversed(range(BITS)) if not mask >> b & 1]
    cuts = [round(k * len(open_bits) / parts) for k in range(parts + 1)]
    return [mask | sum(1 << b for b in open_bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def join_tries(prints: np.ndarray, bounds: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (positions in prints) of the same group within budget differing bits.

    prints: unsigned, ascending in each group; bounds: where groups start, and the end.
    A trie node is a range of prints. All node pairs of a depth are split at once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    lo, hi = bounds[:-1], bounds[1:]
    own = hi - lo > 1
    pairs = np.stack([lo[own], hi[own], lo[own], hi[own], np.zeros(own.sum(), np.int64)])
    for depth in reversed(range(-1, BITS)):
        a, b, c, d, _ = pairs
        leaf = (b - a == 1) & (d - c == 1)
        if leaf.any():
            x, y = a[leaf], c[leaf]
            near = np.bitwise_count(prints[x] ^ prints[y]) <= budget
            found.append((x[near], y[near]))
            pairs = pairs[:, ~leaf]
        if depth < 0 or not pairs.shape[1]:
            break  # no bit is left, or no pair
        ones = np.append(0, np.cumsum((prints >> np.uint64(depth)) & np.uint64(1)).astype(np.int64))
        a, b, c, d, err = pairs
        am, cm = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        same = a == c
        more = err + 1
        grown = np.concatenate(
            [
                np.stack([a, am, c, cm, err]),
                np.stack([am, b, cm, d, err]),
                np.stack([a, am, cm, d, more]),
                np.stack([am, b, c, cm, more])[:, ~same],
            ],
            axis=1,
        )
        a, b, c, d, err = grown
        alive = (b > a) & (d > c) & (err <= budget) & ~((a == c) & (b - a == 1))
        pairs = grown[:, alive]
    if not found:
        none = np.empty(0, np.int64)
        return none, none
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n positions the smallest that links (x, y) reach."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def link_nodes(batches, rows: int = 1 << 16):
    """Links (a, b), a spanning forest, among rows (mask, value, print) that come ordered."""
    held: list[pa.RecordBatch] = []

    def links(t: pa.Table):
        mask, value, prints = (t.column(i).to_numpy() for i in range(3))
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        bounds = np.concatenate([[0], new, [len(mask)]]).astype(np.int64)
        prints = prints.view(np.uint64).copy()
        order = np.lexsort((prints, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        prints = prints[order]
        root = forest(len(prints), *join_tries(prints, bounds))
        at = np.flatnonzero(root != np.arange(len(root)))
        edges = np.unique(np.stack([prints[at], prints[root[at]]]).view(np.int64), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        mask, value = t.column(0).to_numpy(), t.column(1).to_numpy()
        change = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        if len(change):
            cut = int(change[-1]) + 1
            yield links(t.slice(0, cut))
            t = t.slice(cut)
        held = t.to_batches()
    if held and sum(b.num_rows for b in held):
        yield links(pa.Table.from_batches(held).combine_chunks())


def near_links(spark: SparkSession, prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect all distinct prints (column print) within the budget."""
    masks = {0: parts_of(0)}
    rows = prints.select("print", F.explode(F.array(*(F.lit(signed(m)) for m in masks[0]))).alias("mask"))
    edges = None
    for depth in range(DEPTH):
        rows = rows.select("mask", F.col("print").bitwiseAND(F.col("mask")).alias("value"), "print")
        crowded = None
        if depth + 1 < DEPTH:
            crowded = settle(spark, rows.groupBy("mask", "value").count().where(F.col("count") > crowd).select("mask", "value"))
            if crowded.isEmpty():
                crowded = None
        here = rows.join(crowded, ["mask", "value"], "left_anti") if crowded else rows
        found = here.repartition("mask", "value").sortWithinPartitions("mask", "value").select("mask", "value", "print").mapInArrow(link_nodes, "a long, b long")
        edges = found if edges is None else edges.union(found)
        if crowded is None:
            break
        deeper = {p: parts_of(p) for m in masks for p in masks[m]}
        steps = spark.createDataFrame([(signed(m), signed(p)) for m in deeper for p in deeper[m]], "mask long, deeper long")
        kept = rows.join(crowded, ["mask", "value"], "left_semi")
        rows = settle(spark, kept.join(F.broadcast(steps), "mask").select("print", F.col("deeper").alias("mask")))  # at most 243 steps
        masks = deeper
    return edges


def near_duplicates(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, print, root and component_id for each row of df.

    root is the component's representative print, component_id its smallest doc_id.
    """
    docs = settle(spark, df.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("print")))
    prints = settle(spark, docs.groupBy("print").agg(F.min("doc_id").alias("first")))
    roots = components(spark, near_links(spark, prints, crowd)).withColumnRenamed("node", "print")
    named = prints.join(roots, "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    linked = named.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("first").alias("smallest"))
    labels = named.join(linked, "root", "left").select("print", "root", F.coalesce("smallest", "first").alias("component_id"))
    return docs.join(labels, "print").select("doc_id", "print", "root", "component_id")


def keep_one(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """df with one row of each component: that of its smallest id.

    Rows that repeat that id, and components of null ids, are reduced to one row each.
    """
    found = settle(spark, near_duplicates(spark, df, doc_id, text, crowd))
    first = found.where("doc_id <=> component_id")
    odd = first.where("doc_id is null").select("root").union(first.groupBy("root").count().where("count > 1").select("root")).distinct()
    own, root = fresh(df, "kept_id", "kept_root")
    if odd.isEmpty():
        return df.join(first.select(F.col("doc_id").alias(own)), df[doc_id] == F.col(own), "left_semi")
    shown = df.withColumn(root, simhash(F.col(text)))
    prints = first.select(F.col("print").alias(own), F.col("doc_id").alias(f"{own}_"), F.col("root").alias(f"{root}_")).distinct()
    kept = shown.join(prints, shown[root].eqNullSafe(F.col(own)) & shown[doc_id].eqNullSafe(F.col(f"{own}_")))
    return kept.dropDuplicates([f"{root}_"]).select(*df.columns)


#: Signatures of similar texts: BANDS keys, each of ROWS least hashes. A pair shares a key with probability
#: 1 - (1 - s^ROWS)^BANDS: 0.94 at a similarity s of 0.8, 0.98 at 0.85, 0.995 at 0.9; none without a common shingle.
BANDS, ROWS = 4, 3
MULTIPLIERS = np.array([int.from_bytes(xxh64_digest(f"row {i}".encode(), SEED), "big") | 1 for i in range(BANDS * ROWS)], np.uint64)


def shingles_of(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; none without words."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def bands_of(hashes: np.ndarray, block: int = 1 << 12) -> list[int]:
    """The text's keys; texts without words share their own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), block):
        least = np.minimum(least, (hashes[a : a + block, None] * MULTIPLIERS).min(axis=0))
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return [signed(xxh64_intdigest(rows[b].tobytes(), b)) for b in range(BANDS)]


def signature(text: Column, shingle: int) -> Column:
    """Struct (key, bands): a hash of the text's words in order, and its band keys."""

    @F.arrow_udf("struct<key: long, bands: array<long>>")
    def sign(texts: pa.Array) -> pa.Array:
        keys, bands = [], []
        for x in texts.cast(pa.large_binary()):
            raw = x.as_py() or b""
            keys.append(signed(xxh64_intdigest(b" ".join(raw.lower().split()), SEED)))
            bands += bands_of(shingles_of(raw, shingle))
        release()
        ends = np.arange(0, len(bands) + 1, BANDS, dtype=np.int32)
        return pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands, pa.int64()))], ["key", "bands"])

    return sign(text)


def hashes_of(text: Column, shingle: int) -> Column:
    """The distinct hashes of a text's shingles, ascending, packed."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        out = pa.array([shingles_of(x.as_py() or b"", shingle).tobytes() for x in texts.cast(pa.large_binary())], pa.binary())
        release()
        return out

    return pack(text)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """The common share of two sets of hashes (ascending) reaches similarity; sets without any are alike."""
    least, most = sorted((len(a), len(b)))
    if not least:
        return not most or similarity <= 0
    if least / most < similarity:
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common) >= similarity


class Index:
    """Sets of hashes with their places in a group; finds whether one with a smaller place is similar to a set."""

    def __init__(self, sets: list[np.ndarray], places: list[int]):
        self.sizes, self.places = np.array([len(x) for x in sets]), np.array(places)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens)
        self.tokens, self.owner = tokens[order], owner[order]

    def has_before(self, mine: np.ndarray, place: int, similarity: float) -> bool:
        lo, hi = np.searchsorted(self.tokens, mine), np.searchsorted(self.tokens, mine, "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.sizes))
        all_ = np.maximum(self.sizes + len(mine) - common, 1)
        return bool(((self.places < place) & (common / all_ >= similarity)).any())


#: Texts of a group that each of its others is held against first, rows of a group that one task takes with them,
#: and rows of a group's rest that one task holds while the rest that is still there passes by.
PIVOTS, TOGETHER, BLOCK = 48, 2000, 500


def met_in_rest(spark: SparkSession, rest: DataFrame, gone: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Keys of rest (key, grp, place) not in gone (key) that are similar to one of their group in rest at a smaller place; settled.

    A task indexes the sets of a block of a group, then those not gone pass by one after the other.
    """
    marked = settle(spark, rest.join(gone.withColumn("went", F.lit(True)), "key", "left").select("key", "grp", "place", F.col("went").isNull().alias("here")))
    sizes = settle(spark, marked.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.col("here").cast("int")).alias("open")).where("n > 1 and open > 0").select("grp", "n"))
    dealt = join_by_weight(marked, sizes, "grp", "n", marked.count()).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    held = dealt.select("key", "grp", "place", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("is_held"))
    passing = dealt.where("here").select("key", "grp", "place", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("is_held"))
    both = held.unionByName(passing).join(sets.hint("merge"), "key").repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("is_held"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, places, index = None, [], [], None
        for batch in batches:
            found = []
            for key, grp, place, block, is_held, own_set in zip(*(batch.column(c) for c in ("key", "grp", "place", "block", "is_held", "set")), strict=True):
                at, mine = (grp.as_py(), block.as_py()), np.frombuffer(own_set.as_buffer(), np.uint64)
                if at != now:
                    now, own, places, index = at, [], [], None
                if is_held.as_py():
                    own.append(mine.copy())
                    places.append(place.as_py())
                    continue
                if index is None and own:
                    index, own = Index(own, places), []
                if index is not None and index.has_before(mine, place.as_py(), similarity):
                    found.append(key.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["key"])
        release()

    found = settle(spark, both.select("key", "grp", "place", "block", "is_held", "set").mapInArrow(compare, "key long").distinct())
    forget(spark, marked, sizes)
    return found


def drop_similar(spark: SparkSession, df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, pivots: int = PIVOTS) -> DataFrame:
    """df without the rows of texts that are similar to a text with a smaller id, which may itself go for a third.

    SimHash can't find pairs at a similarity of 0.8 (some 9 of 64 bits differ), so texts meet
    by keys of least hashes, BANDS for each. First a text is held against the first (by id) of
    one group, that with the least first; similar ones go, which is the bulk of near copies.
    The others are held against the first `pivots` texts of each of their groups, then what is
    still there against all others of each group. So all pairs that share a key are compared, unless
    one has gone already. Comparisons are exact, of sets of shingles' hashes. A group's rows are dealt
    to blocks, of about TOGETHER with the pivots, of BLOCK afterwards, so no task sees a large group
    whole and pairs are never rows; groups of many unlike texts take quadratic time in the last step.
    Two texts that share no key both stay. Texts with the same words are one. Null ids come last.
    """
    k, sig = fresh(df, "similar_key", "similar_signature")
    signed_rows = settle(spark, df.withColumn(sig, signature(F.col(text), shingle)).withColumn(k, F.col(f"{sig}.key")))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(k).alias("key"))
    nodes = signed_rows.groupBy(F.col(k).alias("key")).agg(F.min(order).alias("first"), F.first(f"{sig}.bands").alias("bands"))
    members = settle(spark, nodes.select("key", "first", F.explode("bands").alias("band")))
    groups = settle(spark, members.groupBy("band").agg(F.min("first").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    inside = settle(spark, join_by_weight(members, groups, "band", "n", members.count()).select("key", "first", "band", "rep", "n"))
    texts = signed_rows.select(F.col(k).alias("key"), F.col(text).alias("text")).join(inside.select("key").distinct().hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    sets = settle(spark, texts.select("key", hashes_of(F.col("text"), shingle).alias("set")))

    def met(rows: DataFrame, firsts: DataFrame) -> DataFrame:
        """Keys of rows (key, first, grp, n) that are similar to one of their group's firsts (key, first, grp, n) with a smaller id."""
        spread = lambda r: F.greatest(F.lit(1), F.ceil(r["n"] / TOGETHER)).cast("int")
        own = rows.withColumn("block", F.pmod(F.xxhash64("key"), spread(rows)).cast("int")).withColumn("is_first", F.lit(False))
        given = firsts.withColumn("block", F.explode(F.sequence(F.lit(0), spread(firsts) - 1))).withColumn("is_first", F.lit(True))
        both = own.unionByName(given).select("key", F.struct("first.none", "first.id", "first.key").alias("first"), "grp", "block", "is_first").join(sets.hint("merge"), "key")
        dealt = both.repartition("grp", "block").sortWithinPartitions("grp", "block", F.desc("is_first"), "first")
        dealt = dealt.select("key", "grp", "block", "is_first", "set")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, {}
            for batch in batches:
                gone = []
                for key, grp, block, is_first, own_set in zip(*(batch.column(c) for c in ("key", "grp", "block", "is_first", "set")), strict=True):
                    key, at = key.as_py(), (grp.as_py(), block.as_py())
                    if at != now:
                        now, held = at, {}
                    mine = np.frombuffer(own_set.as_buffer(), np.uint64)
                    if is_first.as_py():
                        if any(alike(mine, x, similarity) for x in held.values()):
                            gone.append(key)
                        held[key] = mine
                    elif key not in held and any(alike(mine, x, similarity) for x in held.values()):
                        gone.append(key)  # firsts have the group's smallest ids
                yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["key"])
            release()

        return settle(spark, dealt.mapInArrow(compare, "key long").distinct())

    # by first of one group: the group is the first's key
    least = inside.where("key <> rep.key").groupBy("key").agg(F.min("first").alias("first"), F.min("rep").alias("rep"))
    least = settle(spark, least.select("key", "first", F.col("rep.key").alias("grp"), "rep"))
    sizes = settle(spark, least.groupBy("grp").agg(F.count("*").alias("n"), F.first("rep").alias("rep")))
    one = met(join_by_weight(least, sizes.select("grp", "n"), "grp", "n", least.count()).select("key", "first", "grp", "n"), sizes.select(F.col("grp").alias("key"), F.col("rep").alias("first"), "grp", "n"))
    after = settle(spark, inside.join(one, "key", "left_anti").where("key <> rep.key").select("key", "first", F.col("band").alias("grp")))
    left = settle(spark, after.groupBy("grp").agg(F.count("*").alias("n")))
    open_groups = inside.select("key", "first", F.col("band").alias("grp")).join(left.hint("merge"), "grp")
    place = F.row_number().over(Window.partitionBy("grp").orderBy("first"))
    placed = settle(spark, open_groups.withColumn("place", place))
    firsts = placed.where(F.col("place") <= pivots).select("key", "first", "grp", "n")
    rest = met(join_by_weight(after, left, "grp", "n", after.count()).select("key", "first", "grp", "n"), firsts)
    met_so_far = settle(spark, one.union(rest).distinct())
    among = met_in_rest(spark, placed.where(F.col("place") > pivots).select("key", "grp", "place"), met_so_far, sets, similarity)
    gone = settle(spark, met_so_far.union(among).distinct())
    forget(spark, members, groups, inside, sets, least, sizes, one, after, left, placed, rest, met_so_far, among)
    return signed_rows.join(gone.withColumnRenamed("key", k).hint("merge"), k, "left_anti").select(*df.columns)  # nothing bounds what goes


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", as_hex(F.col("print")).alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}

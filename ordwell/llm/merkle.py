"""Operator 12: a Merkle manifest of a dataset, by an associative sparse forest.

Rows are leaves; those of a group (lang) form a tree, and the groups' roots form a tree of
their own, whose root stands for the dataset. ARITY consecutive nodes become one by
hashing their digests, while there is more than one; a level's last run may be shorter.

A forest holds the nodes whose runs aren't complete yet, keyed by tree, level and index.
How many nodes a level has follows from the tree's leaves, so it is known when a run is
complete, and wherever one is, its parent takes its place, up to the root. Forests over
any parts of the leaves merge associatively, in any order. A part of consecutive leaves
leaves at most ARITY - 1 nodes on either side of each level. Parts are merged FAN at a
time, round after round, each round's forests written to the shared folder: a tree of
reductions, in which no task, nor the driver, sees more than FAN forests.

Each merge also gives the runs that it completed. A row's proof is the digests beside its
own, run after run, up to the root: those inside its part are worked out there again, the
few above or across its part's bounds come by a join.

Leaves come in order of group (null first, bytewise) and id (null first); equal ids by
their digests, so repeated rows each are a leaf. Null and empty texts differ, as nulls are
marked. Texts may be very long; only digests leave the first scan. A group may hold any
share of the rows, and there may be as many groups as rows. An empty table has no root
and gives no rows. Columns that fields don't name aren't looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from hashlib import sha256
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordwell.llm.common import LOWER, UPPER, forget, settle, table

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves in a part, about, and forests that meet in one merge.
PART, FAN = 20_000, 16
#: The tree of the groups' roots.
TOP = -1

Key = tuple[int, int, int]


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields' texts, each with its length in bytes; nulls are marked."""
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def width(leaves: int, level: int) -> int:
    """Nodes of a level in a tree with so many leaves."""
    for _ in range(level):
        leaves = ceil(leaves / ARITY)
    return leaves


class Forest:
    """Nodes whose runs aren't complete: (tree, level, run) -> index -> digest. sizes: leaves of each tree."""

    def __init__(self, groups: int):
        self.sizes = {TOP: groups}
        self.open: dict[Key, dict[int, str]] = defaultdict(dict)
        self.runs: dict[Key, list[str]] = {}
        self.roots: dict[int, str] = {}

    def add(self, tree: int, leaves: int, level: int, index: int, node: str) -> None:
        """Put a node in; while that completes a run, its parent follows, and a group's root becomes a leaf of the top."""
        self.sizes[tree] = leaves
        while True:
            n = width(self.sizes[tree], level)
            if n == 1:
                self.roots[tree] = node
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            run = index // ARITY
            key = tree, level, run
            held = self.open[key]
            held[index] = node
            if len(held) < min(ARITY, n - run * ARITY):
                return
            children = [held[i] for i in sorted(held)]
            self.runs[key] = children
            del self.open[key]
            level, index, node = level + 1, run, digest(children)

    def nodes(self) -> Iterator[tuple[int, int, int, int, str]]:
        """(tree, leaves, level, index, digest) of the nodes that wait."""
        for (tree, level, _), held in self.open.items():
            for index, node in held.items():
                yield tree, self.sizes[tree], level, index, node

    def above(self) -> set[Key]:
        """The runs, from those that wait up to the root, that this forest's leaves need for their proofs."""
        out = set()
        for tree, level, run in [k for k, held in self.open.items() if held]:
            while True:
                while width(self.sizes[tree], level) > 1 and (tree, level, run) not in out:
                    out.add((tree, level, run))
                    level, run = level + 1, run // ARITY
                if tree == TOP or width(self.sizes[tree], level) > 1:
                    break
                tree, level, run = TOP, 0, tree // ARITY
        return out


class Proofs:
    """Digests beside a leaf's own on its way to the root, from complete runs."""

    def __init__(self, runs: dict[Key, list[str]], sizes: dict[int, int]):
        self.runs, self.sizes = runs, sizes
        self.kept: dict[tuple[int, int, int], list[tuple[str, str]]] = {}

    def path(self, tree: int, level: int, index: int) -> list[tuple[str, str]]:
        """(joined digests on the left, on the right) of each run from the node up; kept for inner nodes."""
        key = tree, level, index
        if level and key in self.kept:
            return self.kept[key]
        if width(self.sizes[tree], level) == 1:
            out = [] if tree == TOP else self.path(TOP, 0, tree)
        else:
            run = self.runs[tree, level, index // ARITY]
            k = index % ARITY
            out = [("".join(run[:k]), "".join(run[k + 1 :])), *self.path(tree, level + 1, index // ARITY)]
        if level:
            self.kept[key] = out
        return out


def folded(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and the digests beside its path give."""
    for left, right in path:
        node = sha256((left + node + right).encode()).hexdigest()
    return node


NODE = "tree long, leaves long, level int, index long, digest string"
RUN = "tree long, level int, run long, children array<string>"


def merged(spark: SparkSession, nodes: DataFrame, groups: int, parts: int) -> DataFrame:
    """Runs that forests (part, node) complete among each other, by rounds of merges of FAN forests."""
    runs, rounds = [], []

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        forest = Forest(groups)
        for r in zip(*(rows.column(c).to_pylist() for c in ("tree", "leaves", "level", "index", "digest")), strict=True):
            forest.add(*r)
        left, done = list(forest.nodes()), list(forest.runs.items())
        none = [None] * len(done)
        columns = [[r[k] for r in left] + (none if k not in (0, 2) else [key_[0 if k == 0 else 1] for key_, _ in done]) for k in range(5)]
        columns += [[None] * len(left) + [key_[2] for key_, _ in done], [None] * len(left) + [x for _, x in done]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()))
        arrays = [pa.array([key[0].as_py()] * (len(left) + len(done)), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
        return pa.Table.from_arrays(arrays, ["part", "tree", "leaves", "level", "index", "digest", "run", "children"])

    while True:
        parts = ceil(parts / FAN)
        met = nodes.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInArrow(meet, f"part long, {NODE}, run long, children array<string>")
        met = settle(spark, met)
        rounds.append(met)
        runs.append(met.where("run is not null").select("tree", "level", "run", "children"))
        nodes = met.where("run is null").select("part", "tree", "leaves", "level", "index", "digest")
        if parts <= 1:
            break
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    out._rounds = rounds
    return out


def manifest(spark: SparkSession, leaves: DataFrame, part: int = PART) -> DataFrame:
    """leaves (doc_id, grp, leaf, other) with subroot, root, proof_sha256 and folded_root, the root that `other` and the proof give.

    grp is the group; other a second digest of each row, say as found now, to be proved.
    """
    leaves = settle(spark, leaves.select("doc_id", "grp", "leaf", "other", F.monotonically_increasing_id().alias("row")))
    total = leaves.count()
    parts = max(1, ceil(total / part))
    order = [F.col("grp").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "row"]
    placed = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # the id just given has the number of the partition in its upper bits and that of the row in the lower 33
    placed = settle(spark, placed.select("doc_id", "grp", "leaf", "other", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("pos")))
    forget(spark, leaves)

    # a row for each part and group: where the group's rows begin in the part, and how many come before in other parts
    spans = placed.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    own, of_group = Window.partitionBy("part"), Window.partitionBy("grp")
    spans = spans.withColumns({"before": F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "leaves": F.sum("n").over(of_group)})
    spans = settle(spark, spans.withColumn("new", (F.col("before") == 0).cast("long")))
    begun = spans.groupBy("part").agg(F.sum("new").alias("new"))
    begun = settle(spark, begun.select("part", F.coalesce(F.sum("new").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("groups")))
    groups, parts = spans.agg(F.coalesce(F.sum("new"), F.lit(0)), F.coalesce(F.max("part") + 1, F.lit(1))).first()
    # a group that goes on from an earlier part is the last that began before
    number = F.col("groups") + F.sum("new").over(own.orderBy("first").rowsBetween(Window.unboundedPreceding, 0)) - 1
    spans = settle(spark, spans.join(begun, "part").withColumn("tree", number).select("part", "first", "before", "leaves", "tree"))

    zeros = {c: F.lit(None).cast("long") for c in ("before", "leaves", "tree", "run")} | {"level": F.lit(None).cast("int"), "children": F.lit(None).cast("array<string>")}
    told = spans.select("part", F.lit(0).alias("kind"), F.col("first").alias("pos"), "before", "leaves", "tree")
    rows = placed.select("part", F.lit(2).alias("kind"), "pos", "doc_id", "leaf", "other")

    def in_parts(df: DataFrame) -> DataFrame:
        """All rows of a part together, in order, a part after the other."""
        return df.repartition(parts, "part").sortWithinPartitions("part", "kind", "pos")

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
        now, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != now:
                    if held:
                        yield now, held
                    now, held = r["part"], []
                held.append(r)
        if held:
            yield now, held

    def grown(held: list[dict]) -> tuple[Forest, list[tuple[dict, int, int]]]:
        """The part's forest, and its rows with tree and place in it."""
        forest, spans_, k, own_rows = Forest(groups), [r for r in held if r["kind"] == 0], -1, []
        for r in (r for r in held if r["kind"] == 2):
            while k + 1 < len(spans_) and spans_[k + 1]["pos"] <= r["pos"]:
                k += 1
            s = spans_[k]
            index = s["before"] + r["pos"] - s["pos"]
            forest.add(s["tree"], s["leaves"], 0, index, r["leaf"])
            own_rows.append((r, s["tree"], index))
        return forest, own_rows

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number_, held in by_part(batches):
            forest, _ = grown(held)
            left, above = list(forest.nodes()), sorted(forest.above())
            n, m = len(left), len(above)
            columns = [[r[0] for r in left] + [k[0] for k in above], [r[1] for r in left] + [None] * m, [r[2] for r in left] + [k[1] for k in above], [r[3] for r in left] + [None] * m, [r[4] for r in left] + [None] * m, [None] * n + [k[2] for k in above]]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([number_] * (n + m), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["part", "tree", "leaves", "level", "index", "digest", "run"])

    first = settle(spark, in_parts(told.unionByName(rows.select("part", "kind", "pos", "leaf"), allowMissingColumns=True)).mapInArrow(shrink, f"part long, {NODE}, run long"))
    runs = merged(spark, first.where("run is null").drop("run"), groups, parts)
    needed = first.where("run is not null").select("part", "tree", "level", "run").join(runs.hint("merge"), ["tree", "level", "run"])
    needed = needed.select("part", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), "tree", "level", "run", "children")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_part(batches):
            forest, own_rows = grown(held)
            runs_ = forest.runs | {(r["tree"], r["level"], r["run"]): r["children"] for r in held if r["kind"] == 1}
            sizes, tops, out = forest.sizes, {}, []
            proofs = Proofs(runs_, sizes)

            def root_of(tree: int) -> str:
                if tree not in tops:
                    top = 0
                    while width(sizes[tree], top) > 1:
                        top += 1
                    if tree == TOP and not top:
                        return root_of(0)  # the only group's
                    tops[tree] = forest.roots.get(tree) or digest(runs_[tree, top - 1, 0])
                return tops[tree]

            for r, tree, index in own_rows:
                path = proofs.path(tree, 0, index)
                beside = sha256("".join(left + right for left, right in path).encode()).hexdigest()
                out.append((r["doc_id"], r["leaf"], root_of(tree), root_of(TOP), beside, folded(r["other"], path)))
            kinds = (id_kind, *[pa.string()] * 5)
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
            for a in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out[a : a + 5000]], t) for k, t in enumerate(kinds)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind, kind = to_arrow_type(placed.schema["doc_id"].dataType), placed.schema["doc_id"].dataType.simpleString()
    filled = told.withColumns({c: v for c, v in zeros.items() if c not in told.columns})
    every = filled.unionByName(needed, allowMissingColumns=True).unionByName(rows, allowMissingColumns=True)
    out = settle(spark, in_parts(every).mapInArrow(prove, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))
    forget(spark, placed, spans, begun, first, *runs._rounds)
    return out


def changed(text: Column, doc_id: Column) -> Column:
    """The text as tampered with: lower-cased (A-Z) where 3 divides the checksum of the id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what the proofs say of the tampered ones."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", F.col("lang").alias("grp"), leaf(fields).alias("leaf"), leaf([*fields[:-1], changed(F.col("text"), F.col("doc_id"))]).alias("other"))
    found = manifest(spark, leaves)
    return found.select("*", (F.col("folded_root") == F.col("root")).alias("verified"))


# crc32 bit by bit over the id's digits; levels by recursion; a path is folded level by level
OP12_SQL = """WITH RECURSIVE
d AS (SELECT *, 'a' AS x FROM documents),
t AS (SELECT doc_id, lang, text, source, n_chars, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 3 = 0 AS bad FROM d),
f AS (SELECT doc_id, lang, bad, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
  text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM t),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || CASE WHEN bad THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS other FROM f),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM l),
low AS (SELECT 0 AS lv, g, i, n, leaf AS h FROM r
  UNION ALL SELECT lv + 1, g, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lv, g, i // 8, n),
subs AS (SELECT g, h, lv FROM low WHERE n = 1),
top AS (SELECT 0 AS lv, g AS i, (SELECT count(*) FROM subs) AS n, h FROM subs
  UNION ALL SELECT lv + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY lv, i // 8, n),
paths AS (
  SELECT a.g, a.lv, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM low a JOIN low b ON a.g = b.g AND a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.g, a.lv, a.i
  UNION ALL
  SELECT s.g, s.lv + a.lv, s.g, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''), coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')
  FROM subs s JOIN top a ON a.i = s.g // (8 ** a.lv)::BIGINT JOIN top b ON a.lv = b.lv AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY s.g, s.lv, a.lv),
walk AS (SELECT 0 AS lv, g, i, i AS j, other AS h, '' AS beside FROM r
  UNION ALL SELECT w.lv + 1, w.g, w.i, w.j // 8, sha256(p.lft || w.h || p.rgt), w.beside || p.lft || p.rgt
  FROM walk w JOIN subs s ON s.g = w.g JOIN paths p ON p.g = w.g AND p.lv = w.lv AND p.i = CASE WHEN w.lv < s.lv THEN w.j ELSE w.g END),
ends AS (SELECT g, i, arg_max(h, lv) AS folded, arg_max(beside, lv) AS beside FROM walk GROUP BY g, i)
SELECT r.doc_id, r.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(e.beside) AS proof_sha256, e.folded AS folded_root, e.folded = (SELECT h FROM top WHERE n = 1) AS verified
FROM r JOIN subs s ON s.g = r.g JOIN ends e ON e.g = r.g AND e.i = r.i"""
QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": OP12_SQL}

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from ordwell.llm import merkle as m


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def slow_leaf(fields):
    return H(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def slow_tree(nodes):
    """(root, for each leaf the list of (left, right) up to it)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
        at = [i // 8 for i in at]
        nodes = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def slow(rows):
    """Rows (doc_id, grp, leaf, other) -> (doc_id, leaf, subroot, root, proof, folded)."""
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), first(r[0]), r[2])):
        groups.setdefault(r[1], []).append(r)
    trees = [slow_tree([r[2] for r in g]) for g in groups.values()]
    root, tops = slow_tree([t[0] for t in trees])
    out = []
    for g, (sub, paths), top in zip(groups.values(), trees, tops, strict=True):
        for r, path in zip(g, paths, strict=True):
            node = r[3]
            for left, right in path + top:
                node = H(left, node, right)
            out.append((r[0], r[2], sub, root, H(*(x for p in path + top for x in p)), node))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_forest_is_associative(seed):
    """Any parts of the leaves, merged in any order, give the same roots and runs."""
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 7, 8, 9, 63, 64, 65, 300]) for _ in range(rng.choice([1, 8, 9, 20]))]
    leaves = [(t, n, 0, i, H(f"{t}.{i}")) for t, n in enumerate(sizes) for i in range(n)]
    whole = m.Forest(len(sizes))
    for x in leaves:
        whole.add(*x)
    rng.shuffle(leaves)
    forests = []
    for k in range(0, len(leaves), 50):
        f = m.Forest(len(sizes))
        for x in leaves[k : k + 50]:
            f.add(*x)
        forests.append(f)
    runs = {}
    while len(forests) > 1:
        rng.shuffle(forests)
        a, b, f = forests.pop(), forests.pop(), m.Forest(len(sizes))
        for x in [*a.nodes(), *b.nodes()]:
            f.add(*x)
        runs |= a.runs | b.runs
        forests.append(f)
    runs |= forests[0].runs
    roots = [H(f"{t}.0") if n == 1 else slow_tree([H(f"{t}.{i}") for i in range(n)])[0] for t, n in enumerate(sizes)]
    assert whole.roots[m.TOP] == slow_tree(roots)[0] and runs == whole.runs and not list(whole.nodes())


CASES = {
    "one": [(1, "a", "x", "x")],
    "groups": [(i, g, f"{g}{i}", f"{g}{i % 3}") for g in "abcdefghij" for i in range(3)] + [(5, None, "n", "n")],
    "eights": [(i, "g" if i < 512 else "h", str(i), str(i)) for i in range(1024)],
    "odd": [(i, "éa"[i % 2], str(i), str(i + i % 2)) for i in range(777)] + [(None, "a", "q", "q")] * 3 + [(9, "a", "9", "9")] * 40,
    "many groups": [(i, f"g{i:04}", str(i), str(i)) for i in range(600)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("part", [7, 50, 10_000])
def test_manifest(spark, case, part):
    rows = [(a, g, H(x), H(y)) for a, g, x, y in CASES[case]]
    if part == 7:
        rows = rows[:120]
    df = spark.createDataFrame(rows, "doc_id long, grp string, leaf string, other string").repartition(3)
    assert ordered(m.manifest(spark, df, part).collect()) == ordered(slow(rows))


def test_leaves(spark):
    rows = [(1, None, "de", 3, "Äb"), (None, "s", None, None, None), (2, "", "", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    assert [r[0] for r in df.select(m.leaf([df[c] for c in m.FIELDS])).collect()] == [slow_leaf(r) for r in rows]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, grp string, leaf string, other string")
    assert m.manifest(spark, df).count() == 0


def expected(rows):
    tampered = lambda r: (*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])) if zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
    return [(*r, r[5] == r[3]) for r in slow([(r[0], r[2], slow_leaf(r), slow_leaf(tampered(r))) for r in rows])]


def test_query_and_oracle(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*m.FIELDS).collect()]
    want = ordered(expected(rows))
    got = m.op12_merkle_manifest(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(got.collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert ordered(con.execute(m.OP12_SQL).fetchall()) == want


def test_clashing_columns_and_nulls(spark, tmp_path):
    rows = [(1, "s", "de", 2, "AB", 5, "q"), (None, None, None, None, None, None, None), (1, "s", "de", 2, "AB", 5, "q"), (4, "s", "fr", 9, "Lang " * 50_000, 1, "r")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string, part int, leaf string").write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op12_merkle_manifest(spark, str(tmp_path)).collect()
    null = lambda r: zlib.crc32(str(r[0]).encode()) % 3  # noqa: E731, F841
    assert sorted(r.leaf for r in got) == sorted(slow_leaf(r[:5]) for r in rows)
    assert len({r.root for r in got}) == 1 and all(r.verified == (r.folded_root == r.root) for r in got)
    assert next(r for r in got if r.doc_id is None).verified

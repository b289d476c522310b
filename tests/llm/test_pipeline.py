import hashlib
import struct

import __spark_entry__ as entry
import corpus_pipeline
from ordwell.llm import bpe, token_counts


def test_stages_in_order_on_a_small_corpus(spark, tmp_path):
    en = "the water of the river and the house in the forest near the old mill with a bridge over it and a garden "
    rows = [(k, f"{en}{chr(97 + k % 26)}{k} is a name\n" + " ".join(f"w{k}x{i}" for i in range(60)), "en", "s", 0) for k in range(30)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "12345 !!", "en", "s", 0), (102, None, None, None, None)]
    bench = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi")]
    rows.append((103, f"{en}\n{bench[0][1]}", "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(30))
    assert out[3].n_tokens == bpe.tokenizer(token_counts.vocabulary_path()).count([rows[3][1].encode()])[0]


def test_stages_keep_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "more")], "doc_id long, text string, lang string, source string, n_chars long, n_removed string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash", "decontaminate", "bpe_codec"]


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row int, hits string, Gone string, predicted string, n_tokens string"


def test_edges_at_each_stage(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables, at every stage alone."""
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"{words} of the garden {k}", "en", "s", 9) for k in range(8)]
    rows += [(None, None, None, None, None), (20, "", "en", None, 0), (21, words + " x" * 300_000, "en", "s", 1), (22, rows[0][1], "en", "s", 9), rows[0], rows[0], (None, words, "en", "s", 1), (None, words, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "a", "b", "c", "d") for r in rows], COLUMNS)
    few = {"language_id": 2, "line_dedup": 1, "simhash": None, "decontaminate": 0}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for sf_dir in (str(tmp_path), f"{tmp_path}/none"):
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and (few[name] is None or out.count() == len(rows) - few[name]), name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == [], name
    name, last = corpus_pipeline.STAGES[-1]
    assert last(spark, docs, str(tmp_path)).count() == len(rows) and last(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_against_brute_force(spark):
    """run() over the whole small table, each stage's decisions restated plainly on what it was given."""
    from ordwell.llm import decontaminate, language_id, simhash
    from tests.llm import test_decontaminate, test_line_dedup

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    state = {r.doc_id: r for r in docs.collect()}
    labelled = docs.where(~language_id.held_out(docs["doc_id"]))
    filters = language_id.learn(spark, labelled)
    said = dict(zip(state, zip(*filters.decide([r.text for r in state.values()]), strict=True), strict=True))
    state = {k: r for k, r in state.items() if said[k][0] != "und" and said[k][1] >= language_id.LEAST_SCORE}
    left = dict(test_line_dedup.slow([(k, r.text) for k, r in state.items()], 50))
    state = {k: t for k, t in left.items() if t == state[k].text or t.split()}
    prints = {k: simhash.fingerprint_of(t.encode()) for k, t in state.items()}
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] > root[a]:
                    root[b], changed = root[a], True
    state = {k: t for k, t in state.items() if root[k] == k}
    shingles = {k: set(simhash.shingles_of(t.encode(), 5).tolist()) for k, t in state.items()}
    like = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    state = {k: t for k, t in state.items() if not any(a < k and like(a, k) for a in state)}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    machines = decontaminate.machines([(i, t.encode()) for i, t in items], 13)
    for k, t in list(state.items()):
        n, spans, _ = decontaminate.scan(machines, t.encode())
        hit = sum(b - a for a, b in spans)
        if hit and 20 * hit >= n:
            del state[k]
    for k in list(state)[:3]:
        assert test_decontaminate.slow(state[k], items, 13)[1] * 20 < len(test_decontaminate.words(state[k]))
    library = __import__("tokenizers").Tokenizer.from_file(token_counts.vocabulary_path())
    want = {}
    for k, t in state.items():
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[k] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and 50 < len(got) < len(columns) * 200

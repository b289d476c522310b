import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordwell.llm import bpe, bpe_codec, token_counts

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

SIGNS = "aabcdethion  \n\t'sreABC019.,!é ß中  \x1c\x85😀\r-—٣"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def own():
    return bpe.tokenizer(token_counts.vocabulary_path())


def texts():
    rnd = random.Random(1)
    some = ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    some += ["".join(rnd.choice(" 'stredvml' aZ\n.") for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    some += ["a" * 900, "-" * 500 + "=" * 501, " " * 700, "x " * 300 + "  ", "hi<|endoftext|> you  <|endoftext|>", "<|endoftext|>", "\n" * 99]
    some += ["the" * 300 + "中文" * 50, "".join(rnd.choice("aehinorst") for _ in range(4000))]
    return some


@pytest.mark.parametrize("chunk", [1 << 20, 200, 7])
def test_same_as_library(library, own, chunk, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    every = texts()
    raw = [t.encode() for t in every]
    counts, ids = own.count(raw), own.encode(raw)
    for t, n, i, e in zip(every, counts, ids, library.encode_batch(every, add_special_tokens=False), strict=True):
        assert np.frombuffer(i, "<u4").tolist() == e.ids, t
        assert n == len(e.ids)
        assert own.decode(i, block=12) == library.decode(e.ids, skip_special_tokens=False) == t


HARD = ["it's  the thing's\n\n  we'll  do''s 'x 'vex", "中文字符没有空格" * 6 + " é\u3000\u3000x", "QmFzZTY0" * 12 + "==", " \t \n  word" * 3, "a<|endoftext|>b 'll"]


def test_cut_at_every_byte(own, library):
    """Maps of two chunks compose to the library's count wherever the cut is, also inside tokens and characters."""
    for t in HARD:
        raw = t.encode()
        if b"<|" in raw:
            continue
        n = len(library.encode(t, add_special_tokens=False).ids)
        for cut in range(1, len(raw)):
            f, g = own.counter.map_of(raw, 0, cut), own.counter.map_of(raw, cut, len(raw))
            assert own.counter.compose(raw, f, g).total == n, (t, cut)


def test_composition_is_associative(own):
    rnd = random.Random(9)
    for t in HARD:
        raw = t.encode()
        for _ in range(40):
            a, b = sorted(rnd.sample(range(1, len(raw)), 2))
            f, g, h = (own.counter.map_of(raw, x, y) for x, y in ((0, a), (a, b), (b, len(raw))))
            c = own.counter.compose
            assert c(raw, c(raw, f, g), h) == c(raw, f, c(raw, g, h))
        cuts = [0, *sorted(rnd.sample(range(1, len(raw)), 9)), len(raw)]
        maps = [own.counter.map_of(raw, x, y) for x, y in zip(cuts, cuts[1:], strict=False)]
        left = maps[0]
        for m in maps[1:]:
            left = own.counter.compose(raw, left, m)
        assert own.counter.scan(raw, maps) == left == own.counter.map_of(raw, 0, len(raw))


def test_transducer_cut_at_every_byte(own, library, monkeypatch):
    for t in HARD:
        want = np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        for chunk in range(1, 40):
            monkeypatch.setattr(bpe, "CHUNK", chunk)
            assert b"".join(own.ids(t.encode())) == want, (t, chunk)


def test_transducer_emits_early_and_holds_little(own, library):
    """One pre-token of 200,000 bytes: ids come while it is read, and what is held never exceeds a few lookaheads."""
    rnd = random.Random(2)
    for raw in ("".join(rnd.choice("aehinorst") for _ in range(200_000)).encode(), b"=" * 200_000, ("ab" * 100_000).encode()):
        machine, ids, most, early = bpe.Transducer(own.vocabulary), [], 0, 0
        for k in range(0, len(raw), 50):
            ids += machine.feed(raw[k : k + 50])
            most = max(most, len(machine.held))
            early = early or (len(ids) and k + 50)
        assert 0 < early < 3 * 128 and most <= 6 * own.vocabulary.lookahead
        assert ids + machine.end() == library.encode(raw.decode(), add_special_tokens=False).ids


def test_memory_does_not_grow_with_the_text(own):
    """For a text of 23 MB a worker allocates no more than for its chunks of 1 MB."""
    text = ("the quick brown fox's 中文 " * 1000).encode() * 800
    tracemalloc.start()
    n, _, sha = bpe_codec.digest(own, text)
    assert own.count([text])[0] == n and sha == hashlib.sha256(text).hexdigest()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 20e6 and peak < 64 * bpe.CHUNK


def test_states_are_forgotten(library, monkeypatch):
    for name in ("STATES", "WALKS", "WORDS", "KNOWN"):
        monkeypatch.setattr(bpe, name, 10)
    machine = bpe.Tokenizer(token_counts.vocabulary_path())
    for t in (*HARD, "hello there " * 40, "abcdefghijklmnop" * 60):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(machine.ids(t.encode())), "<u4").tolist() == want and machine.count([t.encode()])[0] == len(want)
    assert len(machine.transducer.states) < 300 and len(machine.transducer.words) <= 10


def test_decode_of_broken_bytes(own, library):
    ids = [i for i, b in own.vocabulary.bytes_of.items() if b in (b"\xc3", b"\xe4", b"a")]
    for order in (ids, ids[::-1], ids * 2):
        assert own.decode(np.array(order, "<u4").tobytes()) == library.decode(order, skip_special_tokens=False)


def test_columns(spark, library):
    rows = [(1, None), (2, ""), (3, "Hello world's end"), (3, "Hello world's end"), (None, "a" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = token_counts.count_tokens(df, to="n").collect()
    want = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert [r.n for r in got] == want
    both = bpe_codec.decode_ids(bpe_codec.encode_texts(df)).collect()
    assert [r.decoded for r in both] == [t or "" for _, t in rows]
    assert [len(r.ids) // 4 for r in both] == want
    once = df.select(bpe_codec.round_trip(F.col("text")).alias("r")).select("r.*").collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert [tuple(r) for r in once] == [(len(r.ids) // 4, sha(r.ids), sha(r.decoded.encode())) for r in both]
    assert bpe_codec.digests(df).where(F.col("n_tokens") < 0).count() == 0
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_all_texts_are_counted_by_chunk_maps(monkeypatch):
    """Texts of any length are cut at any byte and their maps composed; counts are the library's, whatever the chunk."""
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t is not None]
    library = tokenizers.Tokenizer.from_file(token_counts.vocabulary_path())
    want = [len(library.encode(t.decode(), add_special_tokens=False).ids) for t in texts]
    calls = {"maps": 0, "compose": 0}
    maps_of, compose = bpe.Counter.maps_of, bpe.Counter.compose

    def counted_maps(self, data, cuts, starts):
        calls["maps"] += len(cuts) - 1
        return maps_of(self, data, cuts, starts)

    def counted_compose(self, data, f, g):
        calls["compose"] += 1
        return compose(self, data, f, g)

    monkeypatch.setattr(bpe.Counter, "maps_of", counted_maps)
    monkeypatch.setattr(bpe.Counter, "compose", counted_compose)
    machine = bpe.Tokenizer(token_counts.vocabulary_path())
    for size in (bpe.MAPPED, 61, 3):
        monkeypatch.setattr(bpe, "MAPPED", size)
        few = texts if size > 3 else texts[:40]
        before = dict(calls)
        assert machine.count(few).tolist() == want[: len(few)]
        total = sum(map(len, few))
        assert calls["maps"] - before["maps"] >= total // size and calls["compose"] - before["compose"] >= total // size - len(few)

import json
import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ordwell.llm import token_files as t
from ordwell.llm.token_counts import vocabulary_path


def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


LIBRARY = library()
ODD = ["a  b", " a", "a ", "a \n b", "  ", "  x  y", "x <|endoftext|> y", "a  <|endoftext|>  b", "don't 'S 's", "z　 w", "  q", "é è ü", "漢字 漢 字", "😀 😀x", "1 22 333", "a\tb c\r\nd", "a \x1c b", "x \x85 y", "word " * 50, "y" * 300 + " z"]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_pieces_are_the_library(text, monkeypatch):
    """However short the pieces of a long text."""
    e = t.encoder(vocabulary_path())
    for long in (1, 3, t.LONG):
        monkeypatch.setattr(t, "LONG", long)
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé \n\t\xa0\u2003　.,1漢<|"), max_size=40), st.integers(1, 9))
def test_any_text(text, long):
    e = t.encoder(vocabulary_path())
    before, t.LONG = t.LONG, long
    try:
        assert np.frombuffer(e.encode([text])[0], e.kind).tolist() == expected(text)
    finally:
        t.LONG = before


def test_a_pretoken_is_encoded_once(monkeypatch):
    """The library gets each distinct pre-token once, however often texts have it; forgetting changes no ids."""
    e = t.Encoder(vocabulary_path())
    texts = [f"some words and {k % 7} more, don't" * 40 for k in range(50)] + ODD + ["".join(map(chr, range(32, 0x3100)))]
    want, given_words, by_library = e.by_library(texts), [], e.by_library
    monkeypatch.setattr(e, "by_library", lambda few: given_words.extend(few) or by_library(few))
    monkeypatch.setattr(t, "TOGETHER", 5000)
    assert e.encode(texts) == want
    assert len(given_words) == len(set(given_words)) and given_words.count(" words") == 1
    monkeypatch.setattr(t, "WORDS", 3)
    assert e.encode(texts) == want and len(e.words) < 5000


class Given:
    """The library, with the texts that it was given."""

    def __init__(self, library):
        self.library, self.texts = library, []

    def encode_batch_fast(self, texts, **more):
        self.texts += texts
        return self.library.encode_batch_fast(texts, **more)


def test_new_words_are_encoded_together(monkeypatch):
    """The library gets few texts for many new words, and each word has the ids it has alone."""
    e = t.Encoder(vocabulary_path())
    words = [f" {chr(97 + k % 26)}é{k:x}漢"[: 2 + k % 7] for k in range(5000)] + [" 's", " '", " <|endoftext|", " d"]
    want = [np.array(expected(w), e.kind).tobytes() for w in words]
    e.library = Given(e.library)
    assert e.by_library(words) == want and len(e.library.texts) < 20
    mixed = [w for few in zip(words, ODD * 251, strict=False) for w in few] + ["", " ", " a <|endoftext|> b"]
    assert e.by_library(mixed) == [np.array(expected(w), e.kind).tobytes() for w in mixed]
    assert e.by_library([" a", " <|endoftext|>", " b"]) == [np.array(expected(w), e.kind).tobytes() for w in (" a", " <|endoftext|>", " b")]
    monkeypatch.setattr(e, "stands", e.stands + 1)  # ids that don't end where words do are taken one by one
    assert e.by_library(words) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé \n\t\xa0\u2003　.,1漢<|"), max_size=9), st.text(alphabet=st.sampled_from("ab'sé \n\t\xa0\u2003　.,1漢<|"), max_size=9))
def test_any_two_together(a, b):
    e = t.encoder(vocabulary_path())
    texts = [f" {a}", f" {b}", a, b, " x"]
    assert e.by_library(texts) == e.one_by_one(texts)


def test_no_white_space_is_taken_for_a_sign():
    """Characters that APART allows at the ends of a text are none of white space to the library's pattern."""
    allowed = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff" and t.APART.fullmatch(f" {c}")]
    pre = LIBRARY.pre_tokenizer
    text = "".join(f" {c}" for c in allowed)
    assert len(pre.pre_tokenize_str(text)) == len(allowed) > 40_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=9))
def test_rows_are_read_together(rows):
    sizes = np.array([len(r) for r in rows], np.int64)
    more, data, at = t.unpack_rows(sizes, *t.pack_rows(np.array([x for r in rows for x in r], np.uint32), sizes))
    ends = np.append(0, np.cumsum(sizes))
    for k, r in enumerate(rows):
        own, raw = more[ends[k] : ends[k + 1]], data[at[k] : at[k + 1]]
        assert (t.controls(own), raw.tobytes()) == t.pack(np.array(r, np.uint32)) and len(own) == len(r)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=9))
def test_rows_are_coded_as_each_alone(rows):
    ranks = np.array([x for r in rows for x in r], np.uint32)
    control, data = t.pack_rows(ranks, np.array([len(r) for r in rows], np.int64))
    assert list(zip(control.to_pylist(), data.to_pylist(), strict=True)) == [t.pack(np.array(r, np.uint32)) for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_coding(values):
    control, data = t.pack(np.array(values, np.uint32))
    assert t.unpack(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4) and len(data) == sum(max(1, -(-v.bit_length() // 8)) for v in values)


def check(spark, df, path, **more):
    t.write_tokens(spark, df, path, **more)
    got = sorted(t.read_tokens(spark, path).collect(), key=lambda r: r.start)
    rows = df.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id if r.doc_id is not None else 0, r.tie))
    start = 0
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = [*expected(r.text), t.END]
        assert (g.doc_id, g.start, g.n_tokens, bytes(g.ids)) == (r.doc_id, start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_files(spark, tmp_path, monkeypatch):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns; many parts and files."""
    rows = [(k, f"text number {k} of many", 1, 2) for k in range(500, 0, -1)]
    rows += [(None, None, 0, 0), (None, "x", 0, 0), (7, "other text", 0, 0), (7, "text number 7 of many", 0, 0), (9, "", 0, 0), (3, "long words here " * 20_000, 0, 0)]
    rows += [(i, x, 0, 0) for i, x in enumerate(ODD, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int, ids int").repartition(5)
    check(spark, df, f"file://{tmp_path}/many", part=2000)
    files = json.load(open(tmp_path / "many/manifest.json"))["files"]
    assert len(files) > 5 and sum(f["documents"] for f in files) == len(rows)
    assert sorted(x for x in os.listdir(tmp_path / "many") if x.endswith(".tok")) == sorted(f["name"] for f in files)
    check(spark, df, f"{tmp_path}/one")


def test_frequent_ids_are_short(spark, tmp_path):
    df = spark.createDataFrame([(k, "a b c d e f g " * 100) for k in range(30)], "doc_id long, text string")
    t.write_tokens(spark, df, str(tmp_path))
    (f,) = json.load(open(tmp_path / "manifest.json"))["files"]
    assert os.path.getsize(tmp_path / f["name"]) < 1.3 * f["ids"] + 2000


def test_text_ids_and_empty(spark, tmp_path):
    df = spark.createDataFrame([("b", "x"), ("a", "y z"), ("é", None)], "doc_id string, text string")
    t.write_tokens(spark, df, f"{tmp_path}/s")
    got = sorted(t.read_tokens(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == ["a", "b", "é"]
    t.write_tokens(spark, df.limit(0), f"{tmp_path}/e")
    assert t.read_tokens(spark, f"{tmp_path}/e").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    """No manifest, no files: half a folder can't be taken for a whole one."""
    df = spark.createDataFrame([(k, f"w {k}") for k in range(40)], "doc_id long, text string")
    t.write_tokens(spark, df, f"{tmp_path}/x")
    bad = spark.createDataFrame([(0, 1, 2, b"\x00", b"ab"), (1, 1, 5, b"\x00", b"ab")], "part int, doc_id long, n long, control binary, data binary").repartition(2, "part")
    os.makedirs(tmp_path / "bad")
    t.put(f"{tmp_path}/bad", "ids.bin", np.arange(5, dtype="<u4").tobytes())
    with pytest.raises(Exception, match="out of bounds"):
        bad.write.format("ordwell_tokens").mode("append").save(f"{tmp_path}/bad")
    assert os.listdir(tmp_path / "bad") == ["ids.bin"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in t.op11_token_files(spark, sf).collect()}
    start = 0
    for r in rows:
        ids = np.array([*expected(r.text), 2], "<u4")
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)

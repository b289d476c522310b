"""Operator 6: BPE encoding and decoding as streaming transducers.

Encoding reads bytes and emits a token once no later byte can change it. The lookahead
that suffices is computed from the merges: how far back a later token can begin, among
the tokens that merges arrive at. The path of tokens that all positions in reach share is
stable (bpe.Transducer); at the end of a pre-token everything is. What is held besides
the text is a chunk's ids and that lookahead, whatever the text's length; pre-tokens of
any length may span chunks. Encodings of short pre-tokens, and transitions, are kept and
looked up, a bounded number of them. Decoding runs the ids' bytes through an incremental
byte-to-text machine. Digests are fed as tokens come.

Nulls count as empty: no ids, empty text. Texts of any length are whole. Ids are packed
as little-endian unsigned 32-bit integers. Repeated rows and ties each get a row; the
results of encode_texts and decode_ids replace a column of their name; an empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm import bpe
from ordwell.llm.common import release, table
from ordwell.llm.token_counts import raw_texts, vocabulary_path


def encoded(text: Column, path: str | None = None) -> Column:
    """Ids of text, packed (binary)."""

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array(bpe.tokenizer(path or vocabulary_path()).encode(raw_texts(texts)), pa.binary())

    return encode(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of packed ids."""

    @F.arrow_udf("string")
    def decode(packed: pa.Array) -> pa.Array:
        machine = bpe.tokenizer(path or vocabulary_path())
        return pa.array([machine.decode(x.as_py()) for x in packed], pa.string())

    return decode(ids)


def encode_texts(df: DataFrame, text: str = "text", to: str = "ids", path: str | None = None) -> DataFrame:
    """df with the packed ids of column text in column to."""
    return df.withColumn(to, encoded(F.col(text), path))


def decode_ids(df: DataFrame, ids: str = "ids", to: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the text of packed ids in column to."""
    return df.withColumn(to, decoded(F.col(ids), path))


def digest(machine: bpe.Tokenizer, text: bytes) -> tuple[int, str, str]:
    """Number of ids, digest of the ids, and digest of the text decoded from them."""
    n, ids_sha, text_sha, decoder = 0, sha256(), sha256(), bpe.Decoder(machine.vocabulary)
    for ids in machine.ids(text):
        n += len(ids) // 4
        ids_sha.update(ids)
        text_sha.update(decoder.feed(ids).encode())
    text_sha.update(decoder.end().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def round_trip(text: Column, path: str | None = None, keep: bool = True) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of what encoded() and decoded() give.

    keep: workers keep vocabulary and transitions for their next tasks; without it they keep half as many,
    and forget them after each task.
    """

    @F.arrow_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()  # what stages before left in this worker
        machine = bpe.tokenizer(path or vocabulary_path(), 1.0 if keep else 0.5)
        for texts in batches:
            rows = [digest(machine, x.as_py() or b"") for x in texts.cast(pa.large_binary())]
            release()
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep:
            machine.rest()
            del machine
            bpe.tokenizer.cache_clear()
            release()

    return both(text)


def digests(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents."""
    return docs.select("doc_id", round_trip(F.col("text"), keep=keep).alias("both")).select("doc_id", "both.*")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op6_bpe_codec": op6_bpe_codec}
ORACLES: dict[str, str] = {}

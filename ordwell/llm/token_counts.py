"""Operator 5: token counts by a compiled finite-state tokenizer.

The vocabulary's merges and its pre-tokenizer become one deterministic machine whose
transitions carry the change of the token count (bpe.Counter). Pre-tokens of short texts
step through it side by side. A long text is cut into chunks at any byte; a chunk's state
map says what it does to the state it meets (up to the first pre-token that starts in it)
and what comes out whatever it meets (the count and state from there on). Maps of chunks
are made independently and compose associatively, neighbours first, as in a parallel scan.

Nulls and empty texts have no tokens. Texts may have any length: a worker holds one
text, and tables for about one chunk of it. Repeated rows and ties each get a row;
the count replaces a column of its name, others pass through; an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm import bpe
from ordwell.llm.common import release, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public tokenizers' package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def raw_texts(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; none for null."""
    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of tokens of text (long). path: vocabulary file; by default the public one by its name on each worker."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        machine = bpe.tokenizer(path or vocabulary_path())
        counts = [n for k in range(0, len(texts), 1000) for n in machine.count(raw_texts(texts.slice(k, 1000))).tolist()]
        release()
        return pa.array(counts, pa.int64())

    return count(text)


def count_tokens(df: DataFrame, text: str = "text", to: str = "n_tokens", path: str | None = None) -> DataFrame:
    """df with the token count of column text in column to."""
    return df.withColumn(to, token_count(F.col(text), path))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}

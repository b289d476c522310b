"""A corpus pipeline: each stage takes the documents its predecessor kept.

A stage is (name, function of (spark, docs, sf_dir)); all but the last return the
columns of documents, and any others that docs has, whatever their names. Between stages
documents are written as Parquet and read again.

Null texts: language identification rejects them; given to a later stage alone they stay
(line dedup, benchmark), are one group of copies (SimHash) or have no tokens. Empty texts
and texts without letters likewise. Null ids: rows stay; rows with the same id and text
are copies of one document; of near-duplicates that all lack an id one stays. Rows may
repeat, texts may be very long, an empty table gives an empty result at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordwell.llm import bpe_codec, decontaminate, language_id, line_dedup, simhash
from ordwell.llm.common import bounded_batches, forget, fresh, settle, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without letters or in none of the learned languages go."""
    bounded_batches(spark)
    (found,) = fresh(docs, "predicted")
    named = language_id.identify(spark, docs, to=found)
    return named.where(language_id.accepted(F.col(found))).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are deleted, and documents that had nothing else; n_chars is counted anew."""
    bounded_batches(spark)
    (gone,) = fresh(docs, "n_removed")
    left = line_dedup.drop_repeated_lines(spark, docs, removed=gone)
    left = left.where((F.col(gone) == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col(gone) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: by SimHash, then those with a similarity of 0.8 on five-word shingles."""
    bounded_batches(spark)
    return simhash.drop_similar(spark, simhash.keep_one(spark, docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark contaminates."""
    bounded_batches(spark)
    (found,) = fresh(docs, "hits")
    seen = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), to=found)
    return seen.where(~decontaminate.contaminated(F.col(found))).select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the text decoded from them."""
    bounded_batches(spark)
    return bpe_codec.digests(docs, keep=False)  # workers go on to other stages: their memory is needed there


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("bpe_codec", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settle(spark, stage(spark, docs, sf_dir))
        if before is not None:
            forget(spark, before)
        before = docs
    return docs


#: Language identification, SimHash and BPE aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None

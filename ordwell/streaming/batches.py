"""Sinks that write each micro-batch once, whatever is stopped and started again.

A batch's rows go to a folder of its own, <path>/batch=<id>, that is written anew if the
batch runs again; Spark gives a batch that didn't end its number and its rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def written(spark: SparkSession, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """What batches wrote; with before, only those with smaller numbers."""
    try:
        rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def each_batch(stream: DataFrame, path: str, result: Callable[[DataFrame, int], DataFrame]) -> DataStreamWriter:
    """A writer that puts result(rows of the batch, its number) under path, each batch once."""

    def put(rows: DataFrame, number: int) -> None:
        rows.persist()  # a result may read the batch several times; each read would run the stream's plan again
        try:
            result(rows, number).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}_state")


def run(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run until the source has no more, with the state store that keyed processors need; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    query.awaitTermination()


def append_new_stream(stream: DataFrame, path: str, key: str) -> DataStreamWriter:
    """Rows of a stream whose key no earlier batch has, one for each key: a catalogue that grows, each row once.

    Only the keys of earlier batches are read; a batch that runs again is compared with
    batches before it, never with what it wrote itself. Rows without a key stay out.
    """

    def new(rows: DataFrame, number: int) -> DataFrame:
        known = written(rows.sparkSession, path, stream.schema, number).select(key)
        return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(known, key, "left_anti").select(*stream.columns)

    return each_batch(stream, path, new)

"""What the corpus operators share: tables, settled intermediate results, clean columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where unset a temporary one, in a single JVM alone."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or getattr(spark, "_ordwell_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = spark._ordwell_dir = f"file://{tempfile.mkdtemp(prefix='ordwell-')}"
    return found


def settle(spark: SparkSession, df: DataFrame, **options: str) -> DataFrame:
    """Write df as Parquet (with the writer's options) to the shared folder and read it again.

    Cuts lineage: lost executors cost a reread, never the work before it.
    """
    path = f"{shared_dir(spark)}/ordwell/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._ordwell_path = path
    return back


def forget(spark: SparkSession, *settled: DataFrame) -> None:
    """Delete the files of settled results that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for df in settled:
        path = jvm.org.apache.hadoop.fs.Path(df._ordwell_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys with more than a thousandth of all rows count as hot: there are at most so many.
HOT = 1000


def join_by_weight(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left_semi) with groups (settled), which has each key once and in n how many rows have it.

    Rows of hot keys aren't brought together: those keys, at most HOT of them whatever
    the size of rows, are broadcast; all others meet in a shuffled join.
    """
    least = total // HOT
    hot = groups.where(F.col(n) > least)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key, how).unionByName(others.join(groups.where(F.col(n) <= least), key, how))


#: Rows of text sent to a worker at once, where the session leaves Spark's default: a batch of long texts then is some MB.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to workers in smaller batches than Spark's default; a session's own setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it was."""
    return F.translate(text, UPPER, LOWER)


@lru_cache(maxsize=1)
def _trim():
    """The C library's way to hand freed memory back, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def release() -> None:
    """In a worker, after a batch: give freed memory back, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to names that df doesn't have, for operators' own columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out

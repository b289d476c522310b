"""Sessions and table access shared by queries, tests and the bench."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A local session with the settings that the engine expects of a cluster."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ordwell")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def cut(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared folder and read again, so that plans built on it stay small.

    The folder is spark.checkpoint.dir; only in a single JVM a temporary one stands in.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cut_as_dealt(df: DataFrame) -> DataFrame:
    """cut(df) that later plans know to be dealt as df was, so they don't shuffle it again.

    An adaptive plan doesn't tell how its rows end up, and a join by default takes only tables dealt
    by all of its keys as they are, so both are set aside while this one is planned.
    """
    conf = df.sparkSession.conf
    before = {k: conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.requireAllClusterKeysForCoPartition")}
    for k in before:
        conf.set(k, "false")
    try:
        return cut(df)
    finally:
        for k, v in before.items():
            conf.set(k, v)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; checkpoints go there too."""
    if not spark.sparkContext.getCheckpointDir():
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="ordwell-"))
    return spark.sparkContext.getCheckpointDir()


#: Rows that one task of a shuffle takes.
TASK_ROWS = 125_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of TASK_ROWS for so many rows; the session's own number at least."""
    return max(-(-rows // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int | None, *keys: str | Column) -> DataFrame:
    """df shuffled by keys, in as many parts as its number of rows asks for, so a task's share doesn't grow with the table.

    Windows, groups and joins by more columns than keys then need no further shuffle. Where the session's
    own number of partitions is enough, or rows isn't known, that stands (and Spark may join small ones).
    """
    parts = -(-(rows or 0) // TASK_ROWS)
    if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(*keys)
    return df.repartition(parts, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

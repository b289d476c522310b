"""Streaming forms: append of detections, sessions, and stateful de-duplication."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ordwell.session import shared_folder


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drained(stream: DataFrame) -> DataFrame:
    """What a stream appends until its source has no more, as a table in the shared folder.

    Event time ends at the source's last watermark: what waits for later rows isn't in it.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def session_counts(events: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """Sessions by gap: key, first, last bound and events. An event exactly gap later stays in the session."""
    return events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first"), "n")


def windowed_counts(events: DataFrame, ts: str, size: str, slide: str | None, watermark: str) -> DataFrame:
    """Tumbling or sliding counts."""
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, size, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


RUNS = "first array<long>, last array<long>, n array<long>, seen array<long>"


def dedup_stream(detections: DataFrame, window: int, key: str = "key", frame: str = "frame", ts: str = "ts", watermark: str = "1 hour", frame_ms: int = 1000) -> DataFrame:
    """(key, first, last, n) of each run of detections of a key with gaps of at most window frames.

    A frame takes frame_ms of event time. A key's state is its open runs, each with the
    event time of its last detection. A run is emitted once the watermark, below which
    nothing comes any more, is beyond the time when another detection could join it; the
    key's timer stands at the earliest such time.
    """
    reach = (window + 1) * frame_ms
    schema = "key string, first long, last long, n long"

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = [list(r) for r in zip(*state.get, strict=True)] if state.exists else []
        for b in batches:
            at = b[ts].astype("datetime64[ms]").astype("int64")
            runs += [[f, f, 1, t] for f, t in zip(b[frame].tolist(), at.tolist(), strict=True)]
        merged: list[list[int]] = []
        for r in sorted(runs):
            if merged and r[0] - merged[-1][1] <= window:
                last = merged[-1]
                merged[-1] = [last[0], max(last[1], r[1]), last[2] + r[2], max(last[3], r[3])]
            else:
                merged.append(r)
        now = state.getCurrentWatermarkMs()
        done, still = [r for r in merged if r[3] + reach < now], [r for r in merged if r[3] + reach >= now]
        if still:
            state.update(tuple(map(list, zip(*still, strict=True))))
            state.setTimeoutTimestamp(max(now, min(r[3] for r in still) + reach) + 1)
        else:
            state.remove()
        yield pd.DataFrame([(k[0], *r[:3]) for r in done], columns=["key", "first", "last", "n"])

    keyed = detections.withColumn("key", F.col(key).cast("string")).withWatermark(ts, watermark).groupBy("key")
    return keyed.applyInPandasWithState(fold, schema, RUNS, "append", GroupStateTimeout.EventTimeTimeout)


def freeze_stream(states: DataFrame, key: str = "key", frame: str = "frame", ts: str = "ts", watermark: str = "1 minute") -> DataFrame:
    """(key, frame, hero): the value at the last living frame, as rows come in order of frames for each key.

    The state is one value for each key; rows of a micro-batch are sorted, and a row that
    comes after a later one of its key is answered with what is known then.
    """

    def fold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        rows = sorted(r for b in batches for r in zip(b[frame].tolist(), b["hero"].tolist(), b["is_dead"].tolist(), strict=True))
        out = []
        for f, hero, dead in rows:
            if not dead or held is None:
                held = hero
            out.append((k[0], f, held))
        if held is not None:
            state.update((held,))
        yield pd.DataFrame(out, columns=["key", "frame", "hero"])

    keyed = states.withColumn("key", F.col(key).cast("string")).withWatermark(ts, watermark).groupBy("key")
    return keyed.applyInPandasWithState(fold, "key string, frame long, hero string", "held string", "append", GroupStateTimeout.NoTimeout)

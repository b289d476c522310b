"""De-duplication of detections as they come: clusters, barriers, splits and votes of the batch operator.

All that decides about a detection lies in its victim's rows near by: a chain of rows of
one (match, victim) with gaps of at most `window` frames holds whole clusters, whole bursts
of resurrections and whatever they separate. So a keyed processor holds rows until a chain
is closed, which is when the watermark is beyond any row that could go on with it, and lets
a closed chain go at once. Each micro-batch then has whole chains only, and the batch
operator on it gives the events that it would give on all rows.

State is the rows of open chains, in a list, and one timer for each key, at the earliest
time that closes one. Rows behind the watermark are dropped by Spark; rows may come in any
order before it, in any cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ordwell.operators.dedup import deduplicate
from ordwell.session import shared_folder
from ordwell.streaming import batches

ROW = "frame long, at long, body string"


class Chains(StatefulProcessor):
    """Holds rows (frame, at, body) until their chain is closed."""

    def __init__(self, window: int, frame_ms: int):
        self.window, self.reach = window, (window + 1) * frame_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("rows", ROW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in zip(b["frame"].tolist(), b["at"].tolist(), b["body"].tolist(), strict=True)]
        yield self.released(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.released([], timerValues.getCurrentWatermarkInMs())

    def released(self, new: list[tuple], mark: int) -> pd.DataFrame:
        rows = sorted([tuple(r) for r in self.held.get()] + new)
        chains: list[list[tuple]] = []
        for r in rows:
            if chains and r[0] - chains[-1][-1][0] <= self.window:
                chains[-1].append(r)
            else:
                chains.append([r])
        closes = [max(at for _, at, _ in c) + self.reach for c in chains]
        still = [r for c, t in zip(chains, closes, strict=True) if t >= mark for r in c]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if still:
            self.held.put(still)
            self.handle.registerTimer(min(t for t in closes if t >= mark) + 1)
        else:
            self.held.clear()
        return pd.DataFrame({"body": [r[2] for c, t in zip(chains, closes, strict=True) if t < mark for r in c]}, dtype=object)

    def close(self) -> None:
        pass


def closed_chains(detections: DataFrame, window: int, ts: str, watermark: str, frame_ms: int) -> DataFrame:
    """The detections (without ts) of chains that the watermark has closed; a frame takes frame_ms of event time."""
    kept = [c for c in detections.columns if c != ts]
    fields = detections.select(*kept).schema
    victim = F.col("player2")
    rows = detections.select("match_id", victim["team"].alias("victim_team"), victim["hero"].alias("victim"), F.col("frame").cast("long").alias("frame"), F.unix_millis(ts).alias("at"), F.to_json(F.struct(*kept)).alias("body"), ts)
    keyed = rows.withWatermark(ts, watermark).groupBy("match_id", "victim_team", "victim")
    out = keyed.transformWithStateInPandas(Chains(window, frame_ms), "body string", "Append", "EventTime")
    return out.select(F.from_json("body", fields).alias("d")).select("d.*")


def deduplicate_stream(detections: DataFrame, path: str, window: int = 60, ts: str = "ts", watermark: str = "1 minute", frame_ms: int = 500):
    """A writer that puts the distinct events behind a stream of detections under path, each once."""
    closed = closed_chains(detections, window, ts, watermark, frame_ms)
    return batches.each_batch(closed, path, lambda rows, _: deduplicate(rows, window).drop("cluster"))


def deduplicated(detections: DataFrame, window: int = 60, ts: str = "ts", watermark: str = "1 minute", frame_ms: int = 500) -> DataFrame:
    """The events of a stream until its source has no more, as a table; what the last watermark left open isn't in it."""
    import uuid

    spark = detections.sparkSession
    path = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    batches.run(deduplicate_stream(detections, path, window, ts, watermark, frame_ms), spark)
    shape = deduplicate(spark.createDataFrame([], detections.drop(ts).schema), window).drop("cluster").schema
    return batches.written(spark, path, shape)

"""Keyed state machines as streams: rows of a series are folded in order as the watermark passes them.

A processor holds a series' rows until the watermark is beyond their time, then hands them, in
order of frames, to a machine: a function of what it remembers and a row that gives what it
remembers next and the rows that it can answer by now. What it remembers is bounded by its
look-back and look-ahead, so results don't depend on how rows were cut into batches or in what
order they came before the watermark. Rows behind the watermark are dropped by Spark. State is
the rows ahead of the watermark, what the machine remembers, and one timer for each series.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ordwell.dims import NO_MECH, WITH_MECH, WITHOUT_MECH
from ordwell.operators.states import SERIES

#: (what it remembers or None, row) -> (what it remembers, [(frame, results)]).
Machine = Callable[[dict | None, dict], tuple[dict, list[tuple[int, dict]]]]


def smoothing(column: str) -> Machine:
    """Three-point smoothing: a row is answered when the next has come; the last one stays open."""

    def step(held: dict | None, row: dict) -> tuple[dict, list[tuple[int, dict]]]:
        value = row[column]
        if held is None:
            return {"out": None, "frame": row["frame"], "value": value}, []
        out = held["value"]
        if held["out"] is not None and held["out"] == value != out:
            out = value
        return {"out": out, "frame": row["frame"], "value": value}, [(held["frame"], {f"{column}_clean": out})]

    return step


def freezing(*columns: str) -> Machine:
    """Values at the last living frame; the first frame is its own base."""

    def step(held: dict | None, row: dict) -> tuple[dict, list[tuple[int, dict]]]:
        if held is None or not row["is_dead"]:
            held = {c: row.get(c) for c in columns}
        return held, [(row["frame"], {f"{c}_clean": held[c] for c in columns})]

    return step


def mech(span: int, mech_hero: str) -> Machine:
    """Mech status and both ready flags, from the status before and the last span frames."""

    def step(held: dict | None, row: dict) -> tuple[dict, list[tuple[int, dict]]]:
        hero, ready, charge = row["hero"], row["is_ult_ready"], row["ult_charge"]
        held = held or {"state": None, "flags": [], "last": None}
        flags = [*held["flags"], ready][-(span + 1) :]
        state, second = held["state"], False
        status = NO_MECH if hero != mech_hero else WITH_MECH if state is None else state
        if held["last"] and hero == mech_hero:
            last = held["last"]
            used = any(a and not b for a, b in zip(flags, flags[1:], strict=False))
            fresh = last["hero"] != hero or charge <= 1 and last["charge"] > 0 and last["status"] == WITHOUT_MECH
            if (row["is_down"] or used) and status == WITH_MECH:
                state = WITHOUT_MECH
            elif used and status == WITHOUT_MECH or fresh:
                state = WITH_MECH
            status = status if state is None else state
            if status == WITHOUT_MECH and ready:
                ready, second = False, True
        now = {"state": state, "flags": flags, "last": {"hero": hero, "charge": charge, "status": status}}
        return now, [(row["frame"], {"mech_status": status, "is_ult_ready_clean": ready, "is_secondary_ult_ready": second})]

    return step


class Folded(StatefulProcessor):
    """Hands rows (frame, at, body) to a machine once the watermark has passed them."""

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", "frame long, at long, body string")
        self.remembered = handle.getValueState("remembered", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [r for b in rows for r in zip(b["frame"].tolist(), b["at"].tolist(), b["body"].tolist(), strict=True)]
        yield self.passed(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.passed(key, [], timerValues.getCurrentWatermarkInMs())

    def passed(self, key: tuple, new: list[tuple], mark: int) -> pd.DataFrame:
        rows = sorted([tuple(r) for r in self.ahead.get()] + new)
        held = json.loads(self.remembered.get()[0]) if self.remembered.exists() else None
        out, still, began = [], [r for r in rows if r[1] >= mark], held
        for frame, _, body in (r for r in rows if r[1] < mark):
            held, answered = self.machine(held, {**json.loads(body), "frame": frame})
            out += answered
        if held is not began:
            self.remembered.update((json.dumps(held),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if still:
            self.ahead.put(still)
            self.handle.registerTimer(min(r[1] for r in still) + 1)
        else:
            self.ahead.clear()
        numbers = {"match_id": [key[0]] * len(out), "slot": [key[1]] * len(out), "frame": [f for f, _ in out]}
        return pd.DataFrame(numbers, dtype="int64").assign(body=pd.Series([json.dumps(r) for _, r in out], dtype=object))

    def close(self) -> None:
        pass


def fold_stream(states: DataFrame, machine: Machine, results: str, columns: list[str], ts: str = "ts", watermark: str = "1 minute") -> DataFrame:
    """(match_id, slot, frame, results) of a stream of states: what machine makes of columns, in order of frames.

    Frames must rise with ts in a series. To be started with batches.run, as it needs that state store.
    """
    body = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    rows = states.select(F.col(SERIES[0]).cast("long").alias("match_id"), F.col(SERIES[1]).cast("long").alias("slot"), F.col("frame").cast("long").alias("frame"), F.unix_millis(ts).alias("at"), body.alias("body"), ts)
    out = rows.withWatermark(ts, watermark).groupBy("match_id", "slot").transformWithStateInPandas(Folded(machine), "match_id long, slot long, frame long, body string", "Append", "EventTime")
    return out.select("match_id", "slot", "frame", F.from_json("body", results).alias("r")).select("match_id", "slot", "frame", "r.*")

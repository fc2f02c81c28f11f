"""Run events on Structured Streaming: state, first terminal event, progress, replays, expiry.

Every keyed state here ends: timers on the event-time watermark (or on the clock, for the
time to live of finished runs) remove it, and the removal is told in the output. Events that
come after the removal are older than the watermark, so the engine drops them as late.
The processors need the RocksDB state store (``use_state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docweave.operators.runs import RUN_TTL_MS, TERMINAL

#: A run without events for so long, in event time, leaves the state.
IDLE_MS = 86_400_000


def use_state_store(spark: SparkSession) -> None:
    """State of custom processors lives in RocksDB; to be set before their first start."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )


def _timed(events: DataFrame, keep_ms: int) -> DataFrame:
    timed = events.withColumn("event_time", F.timestamp_millis("timestamp_ms"))
    return timed.withWatermark("event_time", f"{keep_ms} milliseconds")


def _processed(events: DataFrame, keep_ms: int, processor: StatefulProcessor, out: str, mode: str) -> DataFrame:
    return _timed(events, keep_ms).groupBy("run_id").transformWithStateInPandas(
        processor, outputStructType=out, outputMode=mode, timeMode="EventTime"
    )


class _Idle(StatefulProcessor):
    """A value per run that leaves when no event has come for ``keep_ms`` of event time.

    Subclasses give ``SCHEMA`` of the value, whose last field is the newest event's time,
    ``fold(value, rows)`` and ``shown(run_id, value)``.
    """

    SCHEMA = ""
    COLUMNS: tuple[str, ...] = ()

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.SCHEMA)

    def fold(self, value: tuple | None, rows: pd.DataFrame) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.value.get()) if self.value.exists() else None
        value = before
        for batch in rows:
            value = self.fold(value, batch)
        if before is None or value[-1] != before[-1]:
            if before is not None:
                self.handle.deleteTimer(before[-1] + self.keep_ms)
            self.handle.registerTimer(value[-1] + self.keep_ms)
        self.value.update(value)
        yield pd.DataFrame([(*key, *self.shown(value), False)], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value = tuple(self.value.get())
        self.value.clear()
        yield pd.DataFrame([(*key, *self.shown(value), True)], columns=self.COLUMNS)

    def close(self) -> None:
        pass


class RunFold(_Idle):
    """Status by the last terminal event, stage by the last event, number of events, first time."""

    SCHEMA = "status string, ended_seq long, stage string, last_seq long, events long, created_at long, newest long"
    COLUMNS = ("run_id", "status", "current_stage", "event_count", "created_at", "evicted")

    def fold(self, value, rows):
        status, ended_seq, stage, last_seq, events, created, newest = value or ("running", -1, None, -1, 0, None, None)
        ended = rows[rows["status"].isin(TERMINAL)]
        if len(ended):
            last = ended.loc[ended["seq"].idxmax()]
            if int(last["seq"]) > ended_seq:
                status, ended_seq = last["status"], int(last["seq"])
        last = rows.loc[rows["seq"].idxmax()]
        if int(last["seq"]) > last_seq:
            stage, last_seq = last["stage"], int(last["seq"])
        first, final = int(rows["timestamp_ms"].min()), int(rows["timestamp_ms"].max())
        created = first if created is None else min(created, first)
        return status, ended_seq, stage, last_seq, events + len(rows), created, final if newest is None else max(newest, final)

    def shown(self, value):
        status, _, stage, _, events, created, _ = value
        return status, stage, events, created


class ProgressFold(_Idle):
    """Largest (completed, total) of a run."""

    SCHEMA = "completed long, total long, newest long"
    COLUMNS = ("run_id", "completed", "total", "evicted")

    def fold(self, value, rows):
        completed, total, newest = value or (None, None, None)
        seen = [rows[c].dropna() for c in ("completed", "total", "timestamp_ms")]
        largest = [int(s.max()) if len(s) else None for s in seen]
        return tuple(max((x for x in pair if x is not None), default=None) for pair in zip((completed, total, newest), largest))

    def shown(self, value):
        return value[:2]


class FirstTerminal(StatefulProcessor):
    """Events of a run up to its first terminal one; only that one with ``terminal_only``.

    Runs hold state only once they are closed: the number of the closing event, removed by a
    timer ``keep_ms`` after it. Events of one micro-batch are taken in order of ``seq``.
    """

    def __init__(self, columns: list[str], keep_ms: int, terminal_only: bool):
        self.columns, self.keep_ms, self.terminal_only = columns, keep_ms, terminal_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.closed = handle.getValueState("closed", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.closed.exists():
            for _ in rows:
                pass
            return
        events = pd.concat(list(rows)).sort_values("seq", kind="stable")
        ended = events["status"].isin(TERMINAL).to_numpy().nonzero()[0]
        if len(ended):
            last = events.iloc[ended[0]]
            self.closed.update((int(last["seq"]),))
            self.handle.registerTimer(int(last["timestamp_ms"]) + self.keep_ms)
            events = events.iloc[ended[0] if self.terminal_only else 0 : ended[0] + 1]
        elif self.terminal_only:
            return
        yield events[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.closed.clear()
        return iter([])

    def close(self) -> None:
        pass


class FinishedExpiry(StatefulProcessor):
    """Status changes of runs by the clock; a finished run leaves ``ttl_ms`` after its first event."""

    COLUMNS = ("run_id", "status", "created_at", "expired")

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, created_at long, last_seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, created, last = tuple(self.run.get()) if self.run.exists() else ("running", None, 0)
        before = status
        for batch in rows:
            first = int(batch["timestamp_ms"].min())
            created = first if created is None else min(created, first)
            ended = batch[batch["status"].isin(TERMINAL) & (batch["seq"] > last)]
            if len(ended):
                latest = ended.loc[ended["seq"].idxmax()]
                status, last = latest["status"], int(latest["seq"])
        self.run.update((status, created, last))
        if before not in TERMINAL and status in TERMINAL:
            self.handle.registerTimer(max(created + self.ttl_ms, timerValues.getCurrentProcessingTimeInMs() + 1))
        if status != before or before == "running":
            yield pd.DataFrame([(*key, status, created, False)], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, created, _ = tuple(self.run.get())
        self.run.clear()
        yield pd.DataFrame([(*key, status, created, True)], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def run_state_stream(events: DataFrame, keep_ms: int = IDLE_MS) -> DataFrame:
    """The batch ``run_state`` as updates: a row for each run that a micro-batch touches, and one
    with ``evicted`` when the run leaves after ``keep_ms`` without events.

    Write it in update mode. The last row of a run that is not evicted equals the batch.
    """
    out = "run_id string, status string, current_stage string, event_count bigint, created_at bigint, evicted boolean"
    kept = events.select("run_id", "seq", "stage", "status", "timestamp_ms")
    return _processed(kept, keep_ms, RunFold(keep_ms), out, "Update")


def dedup_replay_stream(events: DataFrame, keep_ms: int = RUN_TTL_MS) -> DataFrame:
    """Replayed events once per (run, seq).

    The state is dropped once the watermark passes the time to live of a run.
    """
    return _timed(events, keep_ms).dropDuplicatesWithinWatermark(["run_id", "seq"])


def _out(events: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)


def terminal_stream(events: DataFrame, keep_ms: int = RUN_TTL_MS) -> DataFrame:
    """The first terminal event of each run, as it arrives; later ones of the run are dropped."""
    return _processed(events, keep_ms, FirstTerminal(events.columns, keep_ms, True), _out(events), "Append")


def open_events_stream(events: DataFrame, keep_ms: int = RUN_TTL_MS) -> DataFrame:
    """Events up to and including the first terminal one; nothing of the run comes after it."""
    return _processed(events, keep_ms, FirstTerminal(events.columns, keep_ms, False), _out(events), "Append")


def expire_runs_stream(events: DataFrame, ttl_ms: int = RUN_TTL_MS) -> DataFrame:
    """Status changes of runs, and one ``expired`` row when a finished run leaves.

    Age counts from the first event of the run. A running run is never dropped: its timer
    only starts once it has finished. State per run is three values.
    """
    keyed = events.select("run_id", "seq", "status", "timestamp_ms").groupBy("run_id")
    return keyed.transformWithStateInPandas(
        FinishedExpiry(ttl_ms), outputStructType="run_id string, status string, created_at bigint, expired boolean",
        outputMode="Append", timeMode="ProcessingTime",
    )


def progress_stream(events: DataFrame, keep_ms: int = IDLE_MS) -> DataFrame:
    """Monotone extraction counter per run as updates; ``evicted`` when the run leaves.

    ``events(run_id, completed, total, timestamp_ms)``; write it in update mode.
    """
    kept = events.select("run_id", "completed", "total", "timestamp_ms")
    out = "run_id string, completed bigint, total bigint, evicted boolean"
    return _processed(kept, keep_ms, ProgressFold(keep_ms), out, "Update")

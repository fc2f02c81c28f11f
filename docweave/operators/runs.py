"""Run events as tables: sequence numbers, state, replay and expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators.ordering import bucketed_row_number

# Terminal states and time to live of a finished run.
TERMINAL = ("succeeded", "failed")
RUN_TTL_MS = 600_000
SEQUENCE_BUCKET_MS = 3_600_000


def event_seq(events: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """Add ``seq``: 1-based arrival order inside each run.

    ``events(run_id, timestamp_ms, ...)``; hours are numbered apart and offset, so one very
    long run does not sit in one task.
    """
    bucket = F.floor(F.col("timestamp_ms") / SEQUENCE_BUCKET_MS)
    return bucketed_row_number(events, ["run_id"], ["timestamp_ms", tiebreak], bucket, "seq")


def run_state(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Status, stage, event count and creation time per run; partial aggregation only.

    Runs without events (from ``runs(run_id)``) are running and idle.
    """
    ended = F.col("status").isin(*TERMINAL)
    state = events.groupBy("run_id").agg(
        F.coalesce(
            F.max_by(F.when(ended, F.col("status")), F.when(ended, F.col("seq"))), F.lit("running")
        ).alias("status"),
        F.max_by("stage", "seq").alias("current_stage"),
        F.count(F.lit(1)).alias("event_count"),
        F.min("timestamp_ms").alias("created_at"),
    )
    if runs is None:
        return state
    joined = runs.select("run_id").distinct().join(state, "run_id", "left")
    return joined.na.fill({"status": "running", "current_stage": "idle", "event_count": 0})


def dedup_replay(events: DataFrame) -> DataFrame:
    """Replayed events once per (run, seq)."""
    return events.dropDuplicates(["run_id", "seq"])


def expire_runs(runs: DataFrame, now_ms: int, ttl_ms: int = RUN_TTL_MS) -> DataFrame:
    """Drop finished runs older than the time to live, measured from creation."""
    old = F.col("status").isin(*TERMINAL) & (F.lit(now_ms) - F.col("created_at") > ttl_ms)
    return runs.where(~old)


def terminal_events(events: DataFrame) -> DataFrame:
    """The first terminal event of each run."""
    columns = [c for c in events.columns if c != "run_id"]
    ended = events.where(F.col("status").isin(*TERMINAL))
    return ended.groupBy("run_id").agg(F.min_by(F.struct(*columns), "seq").alias("e")).select("run_id", "e.*")


def open_stream(events: DataFrame) -> DataFrame:
    """Events up to and including the terminal one; nothing is delivered after it."""
    last = terminal_events(events).select("run_id", F.col("seq").alias("_last"))
    joined = events.join(last, "run_id", "left")
    return joined.where(F.col("_last").isNull() | (F.col("seq") <= F.col("_last"))).drop("_last")


def progress(events: DataFrame) -> DataFrame:
    """Largest (completed, total) seen per run: the counter never goes back."""
    return events.groupBy("run_id").agg(F.max("completed").alias("completed"), F.max("total").alias("total"))

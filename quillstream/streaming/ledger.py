"""The usage ledger as a stream: windowed sums, changes of status, states of parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregates import usage_summary


def summary(ledger: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """hour, phase and sums of each window; rows later than ``late`` no longer count."""
    kept = ledger.filter("recorded_at is not null").withWatermark("recorded_at", late)
    return usage_summary(kept.withColumn("hour", F.window("recorded_at", width)["start"]), "hour", "phase")


#: A task of which nothing was heard for so long, by the times of the events, is forgotten: the state
#: holds active tasks only. Events later than that don't count.
IDLE = "7 days"


def _timed(events: DataFrame, idle: str) -> DataFrame:
    """``at`` in seconds from 0 on, and a watermark on it (a second late, as it starts at 0 and excludes it)."""
    seconds = F.col("at").cast("double")
    return events.withColumns({"at": seconds, "_time": F.timestamp_seconds(seconds + 1)}).withWatermark("_time", idle)


def _ordered(batches: Iterator[pd.DataFrame], *ties: str) -> pd.DataFrame:
    """The events of a batch by time; at one time by their other columns, so that ties have an order."""
    return pd.concat(list(batches)).sort_values(["at", *ties], kind="stable")


def _keep(state: GroupState, value: tuple, at: float) -> None:
    """The state, until the watermark passes its last event."""
    state.update(value)
    state.setTimeoutTimestamp(max(int(at * 1000) + 1000, state.getCurrentWatermarkMs()) + 1)


def changes(events: DataFrame, task: str = "task", status: str = "status", idle: str = IDLE) -> DataFrame:
    """task, status, before: only events that change a task's status.

    Events of one time count in the order of their status. A task that was idle for ``idle`` is as new.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = []
        new = _ordered(batches, "_status")
        for s in new["_status"]:
            if s != last:
                rows.append((key[0], s, last))
                last = s
        _keep(state, (last,), new["at"].iloc[-1])
        yield pd.DataFrame(rows, columns=["task", "status", "before"], dtype=object)

    keyed = _timed(events, idle).select(F.col(task).cast("string").alias("_task"), F.col(status).alias("_status"), "at", "_time")
    return keyed.groupBy("_task").applyInPandasWithState(
        step, "task string, status string, before string", "last string", "append", GroupStateTimeout.EventTimeTimeout
    )


#: Seconds between two reports of progress, and after which a report is due though nothing changed (fixed values).
QUIET, HEARTBEAT = 0.5, 10.0


def throttled(events: DataFrame, idle: str = IDLE) -> DataFrame:
    """task, at, message: reports of progress, at most one in ``QUIET`` seconds unless it is forced.

    events: task, at (seconds), message, forced. A message equal to the last one shows again after
    ``HEARTBEAT`` seconds. Times are those of the events, so that a replay reports the same.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, said = state.get if state.exists else (float("-inf"), None)
        rows = []
        new = _ordered(batches, "message")
        for at, message, forced in new[["at", "message", "forced"]].itertuples(index=False):
            due = at - last >= (HEARTBEAT if message == said else QUIET)
            if forced or due:
                rows.append((key[0], float(at), message))
                last, said = float(at), message
        _keep(state, (last, said), new["at"].iloc[-1])
        yield pd.DataFrame(rows, columns=["task", "at", "message"])

    keyed = _timed(events, idle).select(F.col("task").cast("string").alias("_task"), "at", "_time", "message", F.coalesce("forced", F.lit(False)).alias("forced"))
    return keyed.groupBy("_task").applyInPandasWithState(
        step, "task string, at double, message string", "last double, said string", "append", GroupStateTimeout.EventTimeTimeout
    )


#: How long an upload address of a part holds, in seconds.
EXPIRY = 23 * 3600


def part_states(events: DataFrame, idle: str = IDLE) -> DataFrame:
    """part, state: every new state of a part; an upload address that waits for 23 hours has expired.

    events: part, state, at (seconds). Expiry shows at the next event, so that a replay gives
    the same states whenever it runs. A part whose submission has an unknown outcome stays so.
    Events of one time count in the order of their state; a part idle for ``idle`` is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, since = state.get if state.exists else ("new", 0)
        rows = []
        new = _ordered(batches, "state")
        for s, at in new[["state", "at"]].itertuples(index=False):
            if now in ("done", "failed", "submission_unknown"):
                continue
            if now == "waiting-file" and at - since > EXPIRY:
                rows.append((key[0], "expired"))
                now, since = "expired", int(at)
            if s != now:
                now, since = s, int(at)
                rows.append((key[0], s))
        _keep(state, (now, since), new["at"].iloc[-1])
        yield pd.DataFrame(rows, columns=["part", "state"], dtype=object)

    keyed = _timed(events, idle).select(F.col("part").cast("string").alias("_part"), "state", "at", "_time")
    return keyed.groupBy("_part").applyInPandasWithState(
        step, "part string, state string", "state string, since long", "append", GroupStateTimeout.EventTimeTimeout
    )

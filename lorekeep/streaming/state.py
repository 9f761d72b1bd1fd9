"""Keyed state: deduplication windows, cadences, debounce; as batch folds and as streaming processors.

Every operator has one pure step from state and event to state and decision.  The batch form folds it over a key's
events in order, the streaming form keeps the state between micro-batches; both give the same decisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINDOW, JOURNAL_EVERY, REVIEW_EVERY, REVIEW_FLOOR = 300.0, 10, 15, 10

Step = Callable[[tuple, float], tuple[tuple, bool]]


def dedup_step(window: float = WINDOW) -> Step:
    """Accepted unless within ``window`` of the last accepted event; a duplicate does not move the window."""

    def step(state: tuple, ts: float) -> tuple[tuple, bool]:
        if state and state[0] is not None and ts - state[0] <= window:
            return state, False
        return (ts,), True

    return step


def debounce_step(minutes: float = 30) -> Step:
    """Fires when at least so many minutes (5 at least) have gone since the last firing."""
    gap = max(5.0, minutes) * 60

    def step(state: tuple, ts: float) -> tuple[tuple, bool]:
        if state and state[0] is not None and ts - state[0] < gap:
            return state, False
        return (ts,), True

    return step


def fold(events: DataFrame, key: str, ts: str, step: Step, out: str = "accepted", order: tuple[str, ...] = ()) -> DataFrame:
    """``events`` with the decision of ``step`` for each, folded in order of time within a key.

    The state is one number, so the fold only needs keys and times; a key's events meet in one task, sorted, and are
    walked in batches without being held together.
    """
    rows = events.repartition(key).sortWithinPartitions(key, ts, *order)
    schema = events.schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = object(), ()
        for batch in batches:
            decisions = []
            for k, t in zip(batch[key], batch[ts]):
                k = None if pd.isna(k) else k
                if k != last:
                    last, state = k, ()
                state, yes = step(state, t)
                decisions.append(yes)
            yield batch[schema].assign(**{out: decisions})

    from pyspark.sql.types import BooleanType, StructField, StructType

    return rows.mapInPandas(run, StructType([*events.schema.fields, StructField(out, BooleanType())]))


def dedup_window(events: DataFrame, key: str = "digest", ts: str = "ts", window: float = WINDOW, order: tuple[str, ...] = ()) -> DataFrame:
    return fold(events, key, ts, dedup_step(window), "accepted", order)


def debounce(events: DataFrame, key: str, ts: str, minutes: float = 30, order: tuple[str, ...] = ()) -> DataFrame:
    return fold(events, key, ts, debounce_step(minutes), "fired", order)


def stream_fold(events: DataFrame, key: str, ts: str, step: Step, out: str = "accepted", ttl: float | None = None):
    """The streaming form of ``fold`` for events (key string, ts double): key, ts, decision, in append mode."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else ()
        rows = pd.concat(list(batches)).sort_values(ts)
        decisions = []
        for t in rows[ts]:
            now, yes = step(now, t)
            decisions.append(yes)
        state.update(now)
        if ttl is not None:
            state.setTimeoutDuration(int(ttl * 1000))
        yield pd.DataFrame({key: rows[key], ts: rows[ts], out: decisions})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl is not None else GroupStateTimeout.NoTimeout
    return events.select(key, ts).groupBy(key).applyInPandasWithState(run, f"{key} string, {ts} double, {out} boolean", "last double", "append", timeout)


def once_per_day(events: DataFrame, key: str, ts: str, order: tuple[str, ...] = ()) -> DataFrame:
    """The first event of each key and day."""
    w = Window.partitionBy(key, F.to_date(ts)).orderBy(ts, *order)
    return events.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def journal_cadence(events: DataFrame, key: str, order: list, every: int = JOURNAL_EVERY) -> DataFrame:
    """``events`` with turn_count (after a reset at ``every``) and fires."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumns({"turn_count": F.pmod(n - 1, F.lit(every)) + 1, "fires": F.pmod(n, F.lit(every)) == 0})


def review_step(every: int = REVIEW_EVERY, floor: int = REVIEW_FLOOR) -> Callable[[tuple, int | None, bool | None], tuple[tuple, tuple]]:
    """From (turns, told) and an event's logged turns and pause to (turns, told) and (fires, notice)."""

    def step(now: tuple, logged: int | None, paused: bool | None) -> tuple[tuple, tuple]:
        turns, told = now[0] + 1, now[1]
        due = turns >= every and logged is not None and logged >= floor
        fires, notice = bool(due and not paused), bool(due and paused and not told)
        return (0 if fires else turns, told or notice), (fires, notice)

    return step


def review_cadence(events: DataFrame, key: str, ts: str, logged: str, every: int = REVIEW_EVERY, floor: int = REVIEW_FLOOR, paused: str | None = None) -> DataFrame:
    """``events`` with fires and notice: at ``every`` turns a review fires if enough turns are logged, else it waits.

    ``notice`` marks the one event of a key at which a paused review is first due.
    """
    schema = events.schema.fieldNames()
    step = review_step(every, floor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, now = object(), (0, False)
        for batch in batches:
            decisions = []
            stopped = batch[paused] if paused else [False] * len(batch)
            for k, n, off in zip(batch[key], batch[logged], stopped):
                k = None if pd.isna(k) else k
                if k != last:
                    last, now = k, (0, False)
                now, made = step(now, None if pd.isna(n) else n, None if pd.isna(off) else off)
                decisions.append(made)
            fires, notices = zip(*decisions) if decisions else ((), ())
            yield batch[schema].assign(fires=list(fires), notice=list(notices))

    from pyspark.sql.types import BooleanType, StructField, StructType

    out = StructType([*events.schema.fields, StructField("fires", BooleanType()), StructField("notice", BooleanType())])
    return events.repartition(key).sortWithinPartitions(key, ts).mapInPandas(run, out)


def recently_flushed(files: DataFrame, now: float, seconds: float = 300) -> DataFrame:
    """One row: whether any file has changed within the last seconds."""
    return files.agg(F.coalesce(F.max("mtime") > now - seconds, F.lit(False)).alias("skip"))


def new_turns(turns: DataFrame, keys: tuple[str, ...] = ("sid", "turn_no")) -> DataFrame:
    """Each turn once; on streams the keys are kept as state."""
    return turns.dropDuplicates(list(keys))

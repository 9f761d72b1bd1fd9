"""Keyed folds in event time: a stream's decisions are those of the batch form, however the input was cut into batches.

Rows of a key are kept as a list until the watermark has passed their time, then folded in order of time.  A timer a key
stands at its earliest open row, so that a key costs nothing in a batch that neither brings it rows nor closes any.  Where a state
cannot matter any more after so long without an event (``Fold.lives``), a timer drops it.

The state lives in RocksDB: start queries inside ``rocksdb(spark)``, which names its provider for the session and sets
back what was there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructField, StructType

from . import state

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Fold:
    """One pure step from (state, event) to (state, decisions), an event being its seconds and the ``inputs``."""

    step: Callable[[tuple, tuple], tuple[tuple, tuple]]
    state: str
    start: tuple
    decisions: str
    inputs: tuple[str, ...] = ()
    #: Seconds without an event after which a key's state is the same as none; None where it never is.
    lives: float | None = None


def _of_time(step: state.Step, out: str, lives: float) -> Fold:
    def run(now: tuple, event: tuple) -> tuple[tuple, tuple]:
        now, yes = step(now, event[0])
        return now, (yes,)

    return Fold(run, "last double", (None,), f"{out} boolean", lives=lives)


def dedup(window: float = state.WINDOW) -> Fold:
    return _of_time(state.dedup_step(window), "accepted", window)


def debounce(minutes: float = 30) -> Fold:
    return _of_time(state.debounce_step(minutes), "fired", max(5.0, minutes) * 60)


def journal(every: int = state.JOURNAL_EVERY) -> Fold:
    def run(now: tuple, event: tuple) -> tuple[tuple, tuple]:
        n = now[0] + 1
        return (n % every,), (n, n == every)

    return Fold(run, "turns int", (0,), "turn_count int, fires boolean")


def review(logged: str, paused: str, every: int = state.REVIEW_EVERY, floor: int = state.REVIEW_FLOOR) -> Fold:
    step = state.review_step(every, floor)
    return Fold(lambda now, event: step(now, event[1], event[2]), "turns int, told boolean", (0, False), "fires boolean, notice boolean", (logged, paused))


class _InOrder(StatefulProcessor):
    """The rows of a key until their time has passed, the state, and one timer."""

    def __init__(self, fold: Fold, buffered: StructType, out: StructType, key: str, inputs: list[int], order: list[int]):
        self.fold, self.buffered, self.out, self.key, self.inputs, self.order = fold, buffered, out, key, inputs, order

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", self.buffered)
        self.now = handle.getValueState("now", self.fold.state)

    def _set_timer(self, at: int) -> None:
        """One timer a key: at ``at``, unless an earlier one stands for rows that are kept."""
        standing = list(self.handle.listTimers())
        if self.open.exists() and standing and min(standing) <= at:
            return
        for t in standing:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [tuple(r[n] for n in self.buffered.names) for r in rows]
        if new:
            self._set_timer(-(-min(r[0] for r in new) // 1000))
            self.open.appendList(new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        kept = list(self.open.get()) if self.open.exists() else []
        due, later = [r for r in kept if r[0] <= passed], [r for r in kept if r[0] > passed]
        if not kept:
            self.now.clear()
            return
        # nulls first, as the batch form sorts
        due.sort(key=lambda r: (r[0], *((r[i] is not None, r[i]) for i in self.order)))
        now = tuple(self.now.get()) if self.now.exists() else self.fold.start
        made = Row(*self.out.names)
        for r in due:
            now, decisions = self.fold.step(now, (r[0] / 1e6, *(r[i] for i in self.inputs)))
            yield made(key[0], *r, *decisions)
        self.now.update(now)
        self.open.clear()
        if later:
            self.open.appendList(later)
            self.handle.registerTimer(-(-min(r[0] for r in later) // 1000))
        elif self.fold.lives is not None:
            self.handle.registerTimer(-(-due[-1][0] // 1000) + int(self.fold.lives * 1000) + 1)


def folded(events: DataFrame, key: str, ts: str, fold: Fold, order: tuple[str, ...] = (), keep: tuple[str, ...] = (), delay: str = "10 minutes") -> DataFrame:
    """A stream's key, time, order, inputs and kept columns with the decisions of ``fold``, each once the watermark has passed it.

    The watermark follows the latest ``ts`` (timestamp) by ``delay``.  Rows that are later than that, and rows without a time, are
    left out; a null key is a key.  Rows of equal time are folded by ``order``.  Only rows that the watermark has passed are given: the last ones
    wait for the stream to go on.
    """
    names = list(dict.fromkeys((*order, *fold.inputs, *keep)))
    clash = {key, ts} & set(names)
    if clash:
        raise ValueError(f"key and time are kept anyway: {sorted(clash)}")
    at = "__at_micros"
    rows = events.filter(F.col(ts).isNotNull()).withWatermark(ts, delay).select(key, ts, F.unix_micros(ts).alias(at), *names)
    of = rows.schema
    buffered = StructType([StructField(at, LongType()), *(of[n] for n in names)])
    out = StructType([of[key], *buffered.fields, *StructType.fromDDL(fold.decisions).fields])
    place = lambda columns: [buffered.names.index(c) for c in columns]
    processor = _InOrder(fold, buffered, out, key, place(fold.inputs), place(order))
    made = rows.groupBy(key).transformWithState(processor, out, "Append", "EventTime")
    return made.select(key, F.timestamp_micros(at).alias(ts), *names, *StructType.fromDDL(fold.decisions).names)


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store these folds need, for queries started inside; the session's own setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def run_available(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream of folded events over what its source holds now, continuing at ``folder``; all rows it has given so far."""
    spark = stream.sparkSession
    with rocksdb(spark):
        q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

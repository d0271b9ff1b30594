"""Windows with the clock of each record, over a stream.

The clock is a column that the source attaches, so decisions do not depend on
how records fall into batches. The same column is Spark's event time here: it
never goes back, so Spark drops nothing, and its watermark follows the clock of
the whole input. A key's due windows fire with its next row or, if none comes, by
an event-time timer one batch after the clock has passed; when they fire does
not change what they hold. A keyed function may stand before the windows: both
run in one processor, on the state of the key that rows were routed by."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import from_us, micros
from ..operators.aggregates import Aggregate
from ..operators.fold import PaneFold
from ..operators.windows import Assigner
from .ordered import NULL, frames, in_order, long, tuples, whole
from .process import KeyedState, ProcessFunction
from .state import use_rocksdb

OUT_COLUMNS = ["kind", "key", "s", "e", "result", "firing", "value", "us", "seq"]
OUT = "kind string, key string, s long, e long, result double, firing long, value string, us long, seq long"
_EPOCH = datetime(1970, 1, 1)


def _us(ts: datetime) -> int:
    delta = ts.replace(tzinfo=None) - _EPOCH
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


class WindowProcessor(StatefulProcessor):
    """Keeps a key's cells in map state, and how many late rows it has seen.
    timers: whether idle keys are woken (streams only)."""

    def __init__(self, assigner: Assigner, aggregate: Aggregate, lateness_us: int, process: tuple[ProcessFunction, dict] | None, timers: bool):
        self.assigner, self.aggregate, self.lateness_us, self.process, self.timers = assigner, aggregate, lateness_us, process, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "s long, e long", "state double, fired boolean, firing long")
        self.late = handle.getValueState("late", "n long")
        self.state = KeyedState(handle, self.process[1]) if self.process else None

    def _events(self, key: str | None, us: int, value: str | None, seq: int) -> Iterator[tuple]:
        """(us, value, seq) of what the function makes of a row."""
        if self.process is None:
            yield us, value, seq
            return
        ts = _EPOCH + timedelta(microseconds=us)
        for e in self.process[0](self.state, {"key": key, "value": value, "ts": ts, "seq": seq}):
            yield _us(e["ts"]), e["value"], e["seq"]

    def _steps(self, fold: PaneFold, key: str | None, row: tuple) -> Iterator[tuple]:
        """(us, value, seq, what the fold gives): the clock moves with the row,
        whatever the function makes of it; then come the function's events."""
        value, us, seq, clock = row[0], row[1], row[2], long(row[3])
        yield None, None, None, fold.advance(clock)
        if seq >= 0:
            for us, value, seq in self._events(key, us, whole(value), seq):
                yield us, value, seq, fold.add(us, value, clock)

    def _held(self) -> tuple[PaneFold, dict]:
        held = {(k[0], k[1]): [v[0], v[1], v[2]] for k, v in self.cells.iterator()}
        return PaneFold(self.assigner, self.aggregate, self.lateness_us, held), {w: tuple(c) for w, c in held.items()}

    def _keep(self, fold: PaneFold, before: dict) -> None:
        for w in before.keys() - fold.cells.keys():
            self.cells.removeKey(w)
        for w, c in fold.cells.items():
            if before.get(w) != tuple(c):
                self.cells.updateValue(w, (float(c[0]), c[1], c[2]))
        if self.timers and (due := fold.due()) is not None:
            self.handle.registerTimer(-(-due // 1000))

    def _results(self, key: str | None, rows) -> Iterator[tuple]:
        fold, before = self._held()
        late = 0
        if self.state is not None:
            self.state.begin(key)
        # Spark promises no order within a key's batch; end rows come last.
        for r in in_order(tuples(rows, ["value", "us", "seq", "clock_us"]), lambda r: (r[2] < 0, r[2])):
            for us, value, seq, found in self._steps(fold, key, r):
                for kind, s, e, state, firing in found:
                    if kind == "late":
                        late += 1
                        yield "late", key, s, e, None, None, value, us, seq
                    else:
                        yield "fire", key, s, e, float(state), firing, None, None, None
        self._keep(fold, before)
        if self.state is not None:
            self.state.end()
        if late:
            n = self.late.get()[0] if self.late.exists() else 0
            self.late.update((n + late,))

    def handleInputRows(self, key, rows, timerValues):
        return frames(self._results(whole(key[0]), rows), OUT_COLUMNS)

    def _due(self, key: str | None, clock: int) -> Iterator[tuple]:
        fold, before = self._held()
        for _, s, e, state, firing in fold.advance(clock):
            yield "fire", key, s, e, float(state), firing, None, None, None
        self._keep(fold, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return frames(self._due(whole(key[0]), timerValues.getCurrentWatermarkInMs() * 1000), OUT_COLUMNS)

    def close(self) -> None:
        pass


def exact_windows(rows: DataFrame, assigner: Assigner, aggregate: Aggregate, lateness: timedelta | int | float | str = 0, process: tuple[ProcessFunction, dict] | None = None, bound: timedelta | int | float | str | None = None) -> DataFrame:
    """What bounded `windowed` gives, from rows with key, value, us, seq and
    clock_us: a stream, or bounded rows with their end rows. seq -1 marks an end
    row. process: a function and its states, as keyed_process takes, that runs
    before the windows. bound: that of the clocks; with it a stream's watermark
    stands at the clock after the last record, not before it. The aggregate must
    be foldable into a number."""
    if not aggregate.foldable:
        raise ValueError(f"{aggregate.name} cannot be folded")
    use_rocksdb(rows.sparkSession)
    processor = WindowProcessor(assigner, aggregate, micros(lateness), process, rows.isStreaming)
    if rows.isStreaming:
        # One millisecond below the largest clock: rows at that clock still come.
        after = F.col("clock_us") if bound is None else F.greatest("clock_us", F.col("us") - micros(bound))
        rows = rows.withColumn("clock_at", F.timestamp_micros(after)).withWatermark("clock_at", "1 millisecond")
    # The watermark needs its column up to here only; pandas has no room for its last times.
    rows = rows.select("key", "value", "us", "seq", F.coalesce("clock_us", F.lit(NULL)).alias("clock_us"))
    found = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="Update", timeMode="EventTime" if rows.isStreaming else "None")
    out = found.select("kind", "key", from_us(found["s"]).alias("window_start"), from_us(found["e"]).alias("window_end"), found["result"].cast(aggregate.type).alias("result"), "firing", "value", from_us(found["us"]).alias("ts"), "seq")
    return out


def pending(spark, checkpoint: str, aggregate: Aggregate) -> DataFrame:
    """The windows that a stopped exact job still held, as it would fire them at
    the end of a bounded source: read from the state it left."""
    cells = spark.read.format("statestore").option("stateVarName", "cells").load(checkpoint)
    kept = cells.where("not user_map_value.fired")
    return kept.select(
        F.lit("fire").alias("kind"), F.col("key.key").alias("key"), from_us(F.col("user_map_key.s")).alias("window_start"), from_us(F.col("user_map_key.e")).alias("window_end"),
        F.col("user_map_value.state").cast(aggregate.type).alias("result"), F.col("user_map_value.firing").alias("firing"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("long").alias("seq"),
    )

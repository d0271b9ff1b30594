"""The fluent job: source -> map -> key_by -> [process] -> [window] -> sink.

A Job is immutable; each setter returns a new one. The same job runs over
bounded rows (`plan`, `run`), or over a stream by Spark's watermark or with
exact per-record clocks (`start`)."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .functions.text import window_text
from .model import DEFAULT_BOUND, DEFAULT_CAPACITY, DEFAULT_PARALLELISM, epoch_us, micros
from .operators.aggregates import Aggregate
from .operators.clock import with_clock
from .operators.windows import Assigner, Session
from .plans.bounded import windowed
from .sources.sinks import BatchSink, split_late
from .streaming.checkpoint import SavepointError, Savepoints
from .streaming.exact import exact_windows, pending
from .streaming.native import configure, native_windows, pending_windows
from .streaming.process import ProcessFunction, keyed_process

Expression = str | Column


def _column(x: Expression) -> Column:
    return F.expr(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Job:
    name: str = "job"
    _source: Callable[..., DataFrame] | None = None
    _map: dict | None = None
    _key: Expression | None = None
    _filters: tuple = ()
    _process: tuple[ProcessFunction, dict] | None = None
    _plan: Callable[[DataFrame], DataFrame] | None = None
    _assigner: Assigner | None = None
    _aggregate: Aggregate | None = None
    _sink: BatchSink | None = None
    _side: BatchSink | None = None
    _lateness: int = 0
    _bound: int = field(default_factory=lambda: micros(DEFAULT_BOUND))
    _parallelism: int = DEFAULT_PARALLELISM
    _capacity: int = DEFAULT_CAPACITY
    _data_dir: str | None = None
    _interval: int = 0
    _resume: str | None = None

    def named(self, name: str) -> Job:
        return replace(self, name=name)

    def source(self, source: Callable[..., DataFrame]) -> Job:
        """A function of the session that gives rows of key, value, ts and seq
        (a stream for `start`; the exact tier wants us and clock_us, as format
        `scripted` gives, in place of ts). A function of two arguments gets the
        channel capacity as well."""
        return replace(self, _source=source)

    def map(self, **columns: Expression) -> Job:
        """New key, value or ts columns; it runs before the clock looks at ts.
        `map()` keeps all as they are."""
        if unknown := set(columns) - {"key", "value", "ts"}:
            raise ValueError(f"map cannot set {', '.join(sorted(unknown))}")
        return replace(self, _map=columns)

    def key_by(self, key: Expression) -> Job:
        return replace(self, _key=key)

    def filter(self, condition: Expression) -> Job:
        """Keep rows; dropped rows have moved the clock already."""
        return replace(self, _filters=(*self._filters, condition))

    def process(self, function: ProcessFunction, states: dict) -> Job:
        """A keyed stateful function, see streaming.process."""
        return replace(self, _process=(function, states), _plan=None)

    def process_plan(self, plan: Callable[[DataFrame], DataFrame]) -> Job:
        """A set-based plan for bounded rows in place of a keyed function."""
        return replace(self, _plan=plan, _process=None)

    def window(self, assigner: Assigner, aggregate: Aggregate) -> Job:
        return replace(self, _assigner=assigner, _aggregate=aggregate)

    def sink(self, sink: BatchSink) -> Job:
        return replace(self, _sink=sink)

    def side_output(self, sink: BatchSink) -> Job:
        """Where rows go that are too late."""
        return replace(self, _side=sink)

    # Values that make no sense leave the setting as it is.

    def parallelism(self, n: int) -> Job:
        return replace(self, _parallelism=n) if n > 0 else self

    def channel_capacity(self, n: int) -> Job:
        """Records (or files) that a micro-batch takes at most: what a source of
        two arguments gets as its second."""
        return replace(self, _capacity=n) if n > 0 else self

    def watermark_bound(self, bound: timedelta | int | float | str) -> Job:
        return replace(self, _bound=micros(bound)) if micros(bound) >= 0 else self

    def allowed_lateness(self, lateness: timedelta | int | float | str) -> Job:
        return replace(self, _lateness=micros(lateness)) if micros(lateness) > 0 else self

    def checkpointing(self, data_dir: str, interval: timedelta | int | float | str = 0) -> Job:
        """Keep state under data_dir; interval 0: micro-batches as fast as they come."""
        return replace(self, _data_dir=data_dir, _interval=max(0, micros(interval)))

    def resume_from(self, savepoint: str) -> Job:
        return replace(self, _resume=savepoint)

    def validate(self) -> None:
        for what, value in (("source", self._source), ("map", self._map), ("key_by", self._key), ("sink", self._sink)):
            if value is None:
                raise ValueError(f"job {self.name} has no {what}")
        if (self._assigner is None) != (self._aggregate is None):
            raise ValueError(f"job {self.name} needs both a window assigner and an aggregate, or neither")

    # --- bounded ---------------------------------------------------------

    def _read(self, spark: SparkSession) -> DataFrame:
        takes = len(inspect.signature(self._source).parameters)
        return self._source(spark, self._capacity) if takes > 1 else self._source(spark)

    def _mapped(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({name: _column(x) for name, x in (self._map or {}).items()})
        return rows.withColumn("event_key", F.col("key")).withColumn("key", _column(self._key).cast("string"))

    def plan(self, spark: SparkSession) -> DataFrame:
        """The job over bounded rows. Without a window: key, value, ts, seq. With
        one: what plans.windowed gives, and `text`, the result as text."""
        self.validate()
        rows = with_clock(self._mapped(self._read(spark)), timedelta(microseconds=self._bound)) if self._assigner else self._mapped(self._read(spark))
        for condition in self._filters:
            rows = rows.where(_column(condition))
        if self._plan is not None:
            rows = self._plan(rows)
        elif self._process is not None:
            rows = keyed_process(rows.drop("event_key"), *self._process)
            rows = rows.withColumn("event_key", F.col("key")).withColumn("key", F.col("route_key"))
        if self._assigner is None:
            out = rows.withColumn("key", F.col("event_key")) if "event_key" in rows.columns else rows
            return out.select("key", "value", "ts", "seq")
        found = windowed(rows, self._assigner, self._aggregate, timedelta(microseconds=self._bound), timedelta(microseconds=self._lateness))
        return self._texts(found)

    def _texts(self, found: DataFrame) -> DataFrame:
        return found.withColumn("text", F.when(F.col("kind") == "fire", window_text(F.col("window_start"), F.col("window_end"), self._aggregate.text(F.col("result")))))

    def run(self, spark: SparkSession) -> None:
        """Run over bounded rows into the sink; late rows go to the side output.
        The main sink gets key, value and ts: a result's value is its text and
        its ts the window's end."""
        out = self.plan(spark)
        if self._assigner is None:
            self._sink(out, 0)
            return
        split_late(lambda b, i: self._sink(as_events(b), i), self._side)(out, 0)

    # --- streaming -------------------------------------------------------

    def start(self, spark: SparkSession, exact: bool | None = None) -> StreamingQuery:
        """Start over a stream. exact: per-record clocks (default: if lateness or
        a side output is set; always for a keyed function before a window); the
        source must then give us and clock_us, and map must not set ts."""
        self.validate()
        exact = bool(self._lateness or self._side) if exact is None else exact
        if self._plan is not None:
            raise ValueError("a set-based plan takes bounded rows; a stream takes a keyed function")
        exact = (exact or self._process is not None) and self._assigner is not None
        if exact and "ts" in (self._map or {}):
            raise ValueError("an exact stream takes times and clocks from its source (us, clock_us); map cannot set ts")
        configure(spark)
        spark.conf.set("spark.sql.shuffle.partitions", str(self._parallelism))
        rows = self._read(spark)
        if exact:
            rows = rows.withColumn("ts", F.timestamp_micros("us")) if "ts" not in rows.columns else rows
            rows = rows.withColumns({name: _column(x) for name, x in (self._map or {}).items()}).withColumn("key", _column(self._key).cast("string"))
        else:
            rows = self._mapped(rows)
        for condition in self._filters:
            rows = rows.where(_column(condition) | (F.col("seq") < 0) if exact else _column(condition))
        if self._process is not None and not exact:
            rows = keyed_process(rows, *self._process).select("key", "value", "ts", "seq")
        mode, sink = "append", self._sink
        if self._assigner is not None and exact:
            if "us" not in rows.columns:
                rows = rows.withColumn("us", epoch_us("ts"))
            rows = self._texts(exact_windows(rows.select("key", "value", "us", "seq", "clock_us"), self._assigner, self._aggregate, timedelta(microseconds=self._lateness), self._process, timedelta(microseconds=self._bound)))
            mode, sink = "update", split_late(lambda b, i: self._sink(as_events(b), i), self._side)
        elif self._assigner is not None:
            found = native_windows(rows, self._assigner, self._aggregate, timedelta(microseconds=self._bound)).withColumn("kind", F.lit("fire"))
            rows, sink = self._texts(found), lambda b, i: self._sink(as_events(b), i)
        elif self._process is not None:
            mode = "update"
        writer = rows.writeStream.outputMode(mode).queryName(self.name).foreachBatch(sink)
        if self._data_dir:
            points = Savepoints(spark, self._data_dir)
            if self._resume:
                points.resume(self._resume)
            window = f"{self._assigner}" if self._assigner is not None else None
            points.check(self._parallelism, aggregate=self._aggregate.name if self._aggregate else None, window=window, exact=str(exact))
            writer = writer.option("checkpointLocation", points.checkpoint)
        elif self._resume:
            raise SavepointError("no data directory is set")
        if self._interval:
            writer = writer.trigger(processingTime=f"{self._interval // 1000} milliseconds")
        return writer.start()


def finish(job: Job, spark: SparkSession) -> None:
    """After a job's bounded source has ended and its query has stopped: fire into
    the sink what the state still holds, as if the clock had passed all windows.
    Sessions of the native tier cannot be read back."""
    points = Savepoints(spark, job._data_dir)
    if points.kind().get("exact") == "True":
        held = pending(spark, points.checkpoint, job._aggregate)
    elif isinstance(job._assigner, Session):
        raise ValueError("sessions of the native tier cannot be read back from their state")
    else:
        held = pending_windows(spark, points.checkpoint, job._aggregate).withColumn("kind", F.lit("fire"))
    job._sink(as_events(job._texts(held)), -1)


def as_events(results: DataFrame) -> DataFrame:
    """Window results as events: value is the text, ts the window's end."""
    return results.select("key", F.col("text").alias("value"), F.col("window_end").alias("ts"))

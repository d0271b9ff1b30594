"""Generated events."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..model import from_us, micros
from .scripted import END_US


def _now_us() -> int:
    return round(datetime.now(timezone.utc).timestamp() * 1_000_000)


def generator(spark: SparkSession, count: int, interval: timedelta | int | float | str = 0.1, start_us: int | None = None, keys: int = 4) -> DataFrame:
    """`count` events key-(i % keys) / event-i, one per interval from `start_us`
    (default: now). A count that is not positive gives none; an interval that is
    not positive is 100 ms."""
    step = micros(interval) if micros(interval) > 0 else 100_000
    at = _now_us() if start_us is None else start_us
    i = F.col("id")
    return spark.range(max(0, count)).select(F.concat(F.lit("key-"), (i % keys).cast("string")).alias("key"), F.concat(F.lit("event-"), i.cast("string")).alias("value"), from_us(i * step + at).alias("ts"), i.alias("seq"))


def late_script(spark: SparkSession, count: int, interval: timedelta | int | float | str = 0.1, start_us: int | None = None, repeats: bool = False) -> DataFrame:
    """As generator, with every fifth event one interval early, and with
    `repeats` every seventh a copy of the one before it."""
    step = micros(interval) if micros(interval) > 0 else 100_000
    rows = generator(spark, count, interval, start_us)
    rows = rows.withColumn("ts", F.when(F.col("seq") % 5 == 4, F.expr(f"ts - make_dt_interval(0, 0, 0, {step / 1e6:.6f})")).otherwise(F.col("ts")))
    if repeats:
        again = F.when(F.col("seq") % 7 == 6, F.col("seq") - 1).otherwise(F.col("seq"))
        rows = rows.withColumn("key", F.concat(F.lit("key-"), (again % 4).cast("string"))).withColumn("value", F.concat(F.lit("event-"), again.cast("string")))
    return rows


def generator_stream(spark: SparkSession, rows_per_second: int = 10, keys: int = 4) -> DataFrame:
    """An endless stream of the same events, paced by Spark's rate source."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    i = F.col("value")
    return rate.select(F.concat(F.lit("key-"), (i % keys).cast("string")).alias("key"), F.concat(F.lit("event-"), i.cast("string")).alias("value"), F.col("timestamp").alias("ts"), i.alias("seq"))


class GeneratedSource(DataSource):
    """Format `generated`: the events of late_script as they come due, with the
    exact clock of each, and end rows after the last. Options: count, interval,
    repeats, bound (durations as text), perBatch."""

    @classmethod
    def name(cls) -> str:
        return "generated"

    def schema(self) -> str:
        return "key string, value string, us long, seq long, clock_us long"

    def simpleStreamReader(self, schema):
        return GeneratedReader(self.options)


class GeneratedReader(SimpleDataSourceStreamReader):
    """Its offset holds when it began, so a restart gives the same events."""

    def __init__(self, options):
        self.count, self.per_batch = max(0, int(options.get("count", 10))), max(1, int(options.get("perBatch", 16)))
        self.step = micros(options.get("interval", "100ms")) if micros(options.get("interval", "100ms")) > 0 else 100_000
        self.bound, self.repeats = micros(options.get("bound", "5s")), str(options.get("repeats", "false")).lower() == "true"

    def initialOffset(self) -> dict:
        return {"next": 0, "top": None, "start": _now_us()}

    def _rows(self, start: dict, stop: int) -> tuple[list[tuple], dict]:
        rows, top = [], start["top"]
        for i in range(start["next"], min(stop, self.count)):
            again = i - 1 if self.repeats and i % 7 == 6 else i
            us = start["start"] + i * self.step - (self.step if i % 5 == 4 else 0)
            rows.append((f"key-{again % 4}", f"event-{again}", us, i, None if top is None else top - self.bound))
            top = us if top is None else max(top, us)
        if start["next"] <= self.count < stop:
            rows += [(f"key-{k}", None, END_US, -1, END_US) for k in range(min(4, self.count))]
        return rows, {"next": stop, "top": top, "start": start["start"]}

    def read(self, start: dict):
        at = start["next"]
        if at > self.count:
            return iter([]), start
        due = (_now_us() - start["start"]) // self.step + 1
        stop = min(at + self.per_batch, due, self.count) if at < self.count else self.count + 1
        if stop <= at:
            time.sleep(min(self.step / 1e6, 0.1))
            return iter([]), start
        rows, end = self._rows(start, stop)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start, end["next"])[0])

    def commit(self, end: dict) -> None:
        pass

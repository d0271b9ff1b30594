"""Scripted events: a fixed list, replayed in order.

As a stream it is a Python data source whose offset is the number of events
read and the largest time among them. The reader sees events one by one, so it
attaches the exact clock of each; a restart replays from the stored offset.
After the last event it sends one end row per key (seq -1, clock at the end of
time), upon which exact windows fire all they hold."""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..model import EVENT, END_OF_TIME, micros

END_US = round(END_OF_TIME.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000


def _us(ts: datetime) -> int:
    ts = ts if ts.tzinfo else ts.replace(tzinfo=timezone.utc)
    delta = ts - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def scripted(spark: SparkSession, events: Iterable[tuple[str, str, datetime]]) -> DataFrame:
    """The events as bounded rows, with their place as seq."""
    return spark.createDataFrame([(k, v, ts.replace(tzinfo=None), i) for i, (k, v, ts) in enumerate(events)], EVENT)


def write_script(path: str, events: Iterable[tuple[str, str, datetime]]) -> str:
    """Write a script file: one JSON list [key, value, microseconds] per line."""
    with open(path, "w") as f:
        f.writelines(json.dumps([k, v, _us(ts)]) + "\n" for k, v, ts in events)
    return path


class ScriptedSource(DataSource):
    """Format `scripted`. Options: path (a file the driver reads), bound (a
    duration, default 5 s), perBatch (events per micro-batch, default 1), end
    (`true`: send end rows)."""

    @classmethod
    def name(cls) -> str:
        return "scripted"

    def schema(self) -> str:
        return "key string, value string, us long, seq long, clock_us long"

    def simpleStreamReader(self, schema):
        return ScriptedReader(self.options)


class ScriptedReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.bound = micros(options.get("bound", "5s"))
        self.per_batch = max(1, int(options.get("perBatch", 1)))
        self.end = str(options.get("end", "true")).lower() == "true"
        with open(options["path"]) as f:
            self.events = [tuple(json.loads(line)) for line in f if line.strip()]

    def initialOffset(self) -> dict:
        return {"next": 0, "top": None}

    def seek(self, to: int) -> int:
        """The offset nearest to `to` that the script has."""
        return min(max(to, 0), len(self.events))

    def _rows(self, start: dict, stop: int) -> tuple[list[tuple], dict]:
        top, rows = start["top"], []
        for i in range(self.seek(start["next"]), self.seek(stop)):
            key, value, us = self.events[i]
            rows.append((key, value, us, i, None if top is None else top - self.bound))
            top = us if top is None else max(top, us)
        if self.end and start["next"] <= len(self.events) < stop:
            rows += [(key, None, END_US, -1, END_US) for key in sorted({e[0] for e in self.events})]
        return rows, {"next": stop, "top": top}

    def read(self, start: dict):
        n = len(self.events)
        at = start["next"]
        stop = min(at + self.per_batch, n) if at < n else (n + 1 if self.end else n)
        if at >= n + self.end:
            return iter([]), start
        rows, end = self._rows(start, stop)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._rows(start, end["next"])[0])

    def commit(self, end: dict) -> None:
        pass



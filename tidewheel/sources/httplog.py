"""A partitioned log over HTTP: a streaming source and a sink.

The broker hands out partitions per group (POST /groups/{group}/join), serves
records from an explicit offset (GET /fetch) and takes records (POST /produce)
and group commits (POST /commit). Spark's offset log is the cursor: a batch is
read by exact offsets, so it replays alike after a crash, and the group's
committed offset (the last record read) only follows finished batches."""

from __future__ import annotations

import base64
import json
import re
import threading
import time
import weakref
from urllib.error import HTTPError, URLError
from urllib.parse import quote, urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from ..model import micros

TIMEOUT = 10
MAX_RECORDS = 100
RETRIES = 3
RETRY_SECONDS = 0.5
HEARTBEAT_SECONDS = 3
_PREFIX = re.compile(r"([+-]?\d{1,19})\|", re.ASCII)


def call(base: str, path: str, params: dict | None = None, method: str = "GET", body: bytes | None = None) -> bytes:
    """One request; connection faults are tried again, then raised."""
    url = base.rstrip("/") + path + (f"?{urlencode(params)}" if params else "")
    for attempt in range(RETRIES):
        try:
            with urlopen(Request(url, data=body, method=method), timeout=TIMEOUT) as reply:
                return reply.read()
        except HTTPError:
            raise
        except (URLError, ConnectionError, TimeoutError):
            if attempt == RETRIES - 1:
                raise
            time.sleep(RETRY_SECONDS)
    raise AssertionError("unreachable")


def fetch(base: str, topic: str, partition: int, offset: int, limit: int = MAX_RECORDS) -> tuple[list[dict], int]:
    """(records, next offset) from an explicit offset."""
    reply = json.loads(call(base, "/fetch", {"topic": topic, "partition": partition, "offset": offset, "max_records": limit}))
    return reply.get("records") or [], reply.get("next_offset", offset)


class LogPartition(InputPartition):
    def __init__(self, partition: int, start: int, stop: int):
        self.partition, self.start, self.stop = partition, start, stop


class HttpLogSource(DataSource):
    """Format `httplog`. Options: broker, topic, group, member, maxRecords (per
    partition and batch)."""

    @classmethod
    def name(cls) -> str:
        return "httplog"

    def schema(self) -> str:
        return "key string, value string, ts timestamp, partition int, offset long"

    def streamReader(self, schema):
        return HttpLogReader(self.options)


class Membership:
    """A member of a group: its partitions, its heartbeat and its commits."""

    def __init__(self, options):
        self.base, self.topic = options["broker"], options["topic"]
        self.group, self.member = options.get("group", "tidewheel"), options.get("member", "tidewheel-0")
        self.limit = int(options.get("maxRecords", MAX_RECORDS))
        self.lock = threading.Lock()
        self.generation, self.assigned = self.join()

    def __getstate__(self) -> dict:
        """What a task gets: no lock and no thread."""
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"lock": threading.Lock()}

    def beat_every(self, seconds: float) -> None:
        """Heartbeats from a thread of their own, so that a batch may take longer
        than a session; the thread ends with the process."""

        def run(me: weakref.ref) -> None:
            while (member := me()) is not None:
                try:
                    member.heartbeat()
                except (OSError, ValueError):
                    pass  # the next read or commit meets the same fault and says so
                del member
                time.sleep(seconds)

        threading.Thread(target=run, args=(weakref.ref(self),), daemon=True).start()

    def join(self) -> tuple[int, list[int]]:
        """Join the group; a reply without partitions means partition 0."""
        reply = json.loads(call(self.base, f"/groups/{quote(self.group)}/join", {"topic": self.topic, "member": self.member}, "POST", b""))
        return reply.get("generation", 0), sorted(reply.get("partitions") or [0])

    def heartbeat(self) -> None:
        """Keep the membership; a fenced member joins anew. Cursors stay."""
        try:
            reply = json.loads(call(self.base, f"/groups/{quote(self.group)}/heartbeat", {"topic": self.topic, "member": self.member, "generation": self.generation}, "POST", b"") or b"{}")
            self.generation = reply.get("generation", self.generation)
        except HTTPError as e:
            if e.code not in (404, 409):
                raise
            with self.lock:
                self.generation, self.assigned = self.join()

    def commit_offset(self, p: int, after: int) -> None:
        """Commit the last record read of a partition; a fenced member joins once
        and tries again."""
        body = lambda: json.dumps({"group": self.group, "topic": self.topic, "partition": p, "offset": after - 1, "generation": self.generation}).encode()
        try:
            call(self.base, "/commit", None, "POST", body())
        except HTTPError:
            with self.lock:
                self.generation, self.assigned = self.join()
            call(self.base, "/commit", None, "POST", body())


def _text(x: str | None) -> str:
    return base64.b64decode(x or "").decode()


class HttpLogReader(Membership, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.seen: dict[int, int] = {}
        self.beat_every(float(options.get("heartbeatSeconds", HEARTBEAT_SECONDS)))

    def __reduce__(self):
        return _Read, (self.base, self.topic, self.limit)

    def initialOffset(self) -> dict:
        return {str(p): 0 for p in self.assigned}

    def latestOffset(self) -> dict:
        self.heartbeat()
        for p in self.assigned:
            self.seen[p] = self._end(p, self.seen.get(p, 0))
        return {str(p): self.seen[p] for p in sorted(self.seen)}

    def _end(self, p: int, at: int) -> int:
        """The end of the next batch of a partition. Where a whole batch is there,
        its last record alone is fetched to know so."""
        last = at + self.limit - 1
        if any(r["offset"] == last for r in fetch(self.base, self.topic, p, last, 1)[0]):
            return last + 1
        found, after = fetch(self.base, self.topic, p, at, self.limit)
        return max(at, after) if found else at

    def partitions(self, start: dict, end: dict) -> list[LogPartition]:
        for p, after in start.items():  # after a restart Spark, not the group, knows the place
            self.seen[int(p)] = max(self.seen.get(int(p), 0), after)
        return [LogPartition(int(p), start.get(p, 0), stop) for p, stop in sorted(end.items()) if stop > start.get(p, 0)]

    def read(self, partition: LogPartition):
        return _Read(self.base, self.topic, self.limit).read(partition)

    def commit(self, end: dict) -> None:
        """Called for a finished batch only: commit the last record of each
        partition."""
        for p, after in end.items():
            self.seen[int(p)] = max(self.seen.get(int(p), 0), after)
            if after > 0:
                self.commit_offset(int(p), after)


class _Read:
    """What a task needs to read a slice of a partition."""

    def __init__(self, base: str, topic: str, limit: int):
        self.base, self.topic, self.limit = base, topic, limit

    def read(self, partition: LogPartition):
        from datetime import datetime, timezone

        for r in records(self.base, self.topic, partition.partition, partition.start, partition.stop, self.limit):
            ts = datetime.fromtimestamp(r["timestamp_ns"] // 1000 / 1e6, timezone.utc)
            yield _text(r.get("key")), _text(r.get("value")), ts, partition.partition, r["offset"]


def records(base: str, topic: str, partition: int, start: int, stop: int, limit: int):
    """The records of a partition from start up to stop, which must be there."""
    at = start
    while at < stop:
        found, after = fetch(base, topic, partition, at, min(limit, stop - at))
        if not found:
            raise RuntimeError(f"partition {partition} lost records from {at} to {stop}")
        yield from (r for r in found if r["offset"] < stop)
        at = after


class ClockedLogSource(DataSource):
    """Format `httplog_clocked`: the log with the exact clock of each record, as
    the exact tier takes it. One reader sees the records one by one, batch by
    batch, partition by partition; a batch is read again by its offsets alone, so
    clocks do not change in a replay. Options as `httplog`, and bound (a duration,
    default 5 s) and prefix (`true`: a value's time prefix is its time)."""

    @classmethod
    def name(cls) -> str:
        return "httplog_clocked"

    def schema(self) -> str:
        return "key string, value string, us long, seq long, clock_us long"

    def simpleStreamReader(self, schema):
        return ClockedLogReader(self.options)


class ClockedLogReader(Membership, SimpleDataSourceStreamReader):
    """Its offset: the place in each partition, records so far, their largest time."""

    def __init__(self, options):
        super().__init__(options)
        self.bound = micros(options.get("bound", "5s"))
        self.prefix = str(options.get("prefix", "false")).lower() == "true"
        self.beat_every(float(options.get("heartbeatSeconds", HEARTBEAT_SECONDS)))

    def initialOffset(self) -> dict:
        return {"at": {str(p): 0 for p in self.assigned}, "seq": 0, "top": None}

    def _rows(self, start: dict, found) -> tuple[list[tuple], dict]:
        """found: (partition, record) in order. Rows, and the offset after them."""
        rows, at, seq, top = [], dict(start["at"]), start["seq"], start["top"]
        for p, r in found:
            value, us = _text(r.get("value")), r["timestamp_ns"] // 1000
            if self.prefix and (m := _PREFIX.match(value)) and -(2**63) <= int(m[1]) < 2**63:
                us = int(m[1]) // 1000
            rows.append((_text(r.get("key")), value, us, seq, None if top is None else top - self.bound))
            top, seq = us if top is None else max(top, us), seq + 1
            at[str(p)] = r["offset"] + 1
        return rows, {"at": at, "seq": seq, "top": top}

    def read(self, start: dict):
        found = []
        for p in sorted({*self.assigned, *map(int, start["at"])}):
            at = start["at"].get(str(p), 0)
            found += [(p, r) for r in fetch(self.base, self.topic, p, at, self.limit)[0] if r["offset"] >= at]
        rows, end = self._rows(start, found)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        found = ((int(p), r) for p, stop in sorted(end["at"].items(), key=lambda x: int(x[0])) for r in records(self.base, self.topic, int(p), start["at"].get(p, 0), stop, self.limit))
        return iter(self._rows(start, found)[0])

    def commit(self, end: dict) -> None:
        for p, after in end["at"].items():
            if after > 0:
                self.commit_offset(int(p), after)


def write_log(batch: DataFrame, broker: str, topic: str, key: str = "key", value: str = "value") -> None:
    """Send each row of a batch; the broker picks the partition. At least once:
    a retried task sends its rows again, so values should name their window."""

    def send(rows):
        for r in rows:
            call(broker, "/produce", {"topic": topic, "partition": -1, "key": r[key]}, "POST", (r[value] or "").encode())

    batch.select(key, value).foreachPartition(send)

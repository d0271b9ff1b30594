"""Keyed stateful functions: (state, event) -> events.

The same function serves bounded rows and streams. State is declared by name:
{"seen": ("map", "value string", "flag boolean")} and so on. The function runs
for each row of a key in arrival order; it may change an event's key, but the
row keeps `route_key`, by which windows that follow go on.

What a function reads and writes of a key is held in memory while the key's rows
pass. A stream reads it from the state store when it is first asked for and
writes it back once, after the key's rows; bounded rows need no store, as nothing
outlives them. Neither holds a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import epoch_us
from .ordered import CHUNK, NULL, frames, from_micros, in_order, long, tuples, whole
from .state import use_rocksdb

COLUMNS = ["key", "value", "ts", "seq"]

#: Entries of a map, or new items of a list, after which a stream writes back
#: what it holds of a key before the key's rows have passed.
HELD = 50_000


def _plain(got):
    return got[0] if len(got) == 1 else tuple(got)


def _row(value) -> tuple:
    return value if isinstance(value, tuple) else (value,)


class ValueCell:
    """One value of a key. state: the store's, or None for none."""

    def __init__(self, state=None):
        self._state = state
        self.begin()

    def begin(self) -> None:
        """A new key's rows begin."""
        self._known, self._value, self._changed = self._state is None, None, False

    def flush(self) -> None:
        """Write back what has changed."""
        if self._changed and self._state is not None:
            if self._value is None:
                self._state.clear()
            else:
                self._state.update(self._value)
        self._changed = False

    def get(self):
        """(value, whether it is set)."""
        if not self._known:
            self._value, self._known = (tuple(self._state.get()) if self._state.exists() else None), True
        return (None, False) if self._value is None else (_plain(self._value), True)

    def set(self, value) -> None:
        self._value, self._known, self._changed = _row(value), True, True

    def clear(self) -> None:
        self._value, self._known, self._changed = None, True, True


class ListCell:
    """Items of a key: those that are known to stand in the store, if they were
    asked for, then new ones."""

    def __init__(self, state=None):
        self._state = state
        self.begin()

    def begin(self) -> None:
        self._old, self._new, self._cleared = ([] if self._state is None else None), [], False

    def flush(self) -> None:
        if self._state is not None:
            if self._cleared and self._new:
                self._state.put(self._new)
            elif self._cleared:
                self._state.clear()
            elif self._new:
                self._state.appendList(self._new)
            self._old, self._new = (None if self._old is None else self._old + self._new), []
        self._cleared = False

    def get(self) -> list:
        if self._old is None:
            self._old = [tuple(x) for x in self._state.get()] if self._state.exists() else []
        return [_plain(x) for x in (*self._old, *self._new)]

    def add(self, value) -> None:
        self._new.append(_row(value))
        if self._state is not None and len(self._new) > HELD:
            self.flush()
            self._old = None

    def clear(self) -> None:
        self._old, self._new, self._cleared = [], [], True


class MapCell:
    """Entries of a key by a map key. `_held` has those that were asked for or
    put, None for one that is not there; `_empty` says that the store has no others."""

    def __init__(self, state=None):
        self._state = state
        self.begin()

    def begin(self) -> None:
        self._held, self._changed, self._cleared = {}, set(), False
        self._empty = True if self._state is None else None

    def flush(self) -> None:
        if self._state is not None:
            if self._cleared:
                self._state.clear()
            for at in self._changed:
                if (value := self._held[at]) is not None:
                    self._state.updateValue(at, value)
                elif not self._cleared and self._state.exists() and self._state.containsKey(at):
                    self._state.removeKey(at)
        self._changed, self._cleared = set(), False

    def _room(self) -> None:
        if self._state is not None and len(self._held) > HELD:
            self.flush()
            self._held, self._empty = {}, None

    def get(self, key):
        """(value, whether it is there)."""
        at = _row(key)
        if at not in self._held:
            if self._empty is None:
                self._empty = not self._state.exists()
            if self._empty:
                return None, False
            self._held[at] = tuple(self._state.getValue(at)) if self._state.containsKey(at) else None
            self._room()
            return self.get(key) if at not in self._held else self._found(at)
        return self._found(at)

    def _found(self, at: tuple):
        value = self._held[at]
        return (None, False) if value is None else (_plain(value), True)

    def put(self, key, value) -> None:
        at = _row(key)
        self._held[at] = _row(value)
        self._changed.add(at)
        self._room()

    def remove(self, key) -> None:
        at = _row(key)
        if self._state is None:
            self._held.pop(at, None)
            return
        self._held[at] = None
        self._changed.add(at)
        self._room()

    def __len__(self) -> int:
        if self._state is None:
            return len(self._held)
        self.flush()
        return sum(1 for _ in self._state.keys()) if self._state.exists() else 0

    def clear(self) -> None:
        self._held, self._changed, self._cleared, self._empty = {}, set(), True, True


class KeyedState:
    """The state of the key at hand, in the store of `handle`, or in memory only
    while the key's rows pass. Call `begin` before a key's rows, `end` after them."""

    def __init__(self, handle: StatefulProcessorHandle | None, states: dict[str, tuple]):
        self.key: str | None = None
        make = {"value": ("getValueState", ValueCell), "list": ("getListState", ListCell), "map": ("getMapState", MapCell)}
        self._cells = {name: make[kind][1](getattr(handle, make[kind][0])(name, *schemas) if handle is not None else None) for name, (kind, *schemas) in states.items()}

    def __getitem__(self, name: str):
        return self._cells[name]

    def begin(self, key: str | None) -> None:
        self.key = key
        for cell in self._cells.values():
            cell.begin()

    def end(self) -> None:
        for cell in self._cells.values():
            cell.flush()


ProcessFunction = Callable[[KeyedState, dict], Iterable[dict]]

_OUT = ["route_key", "key", "value", "us", "seq", "clock_us"]


class _Processor(StatefulProcessor):
    def __init__(self, function: ProcessFunction, states: dict[str, tuple], zoned: bool):
        self.function, self.states, self.zoned = function, states, zoned

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = KeyedState(handle, self.states)

    def _events(self, key: str | None, rows) -> Iterator[tuple]:
        self.state.begin(key)
        for value, us, seq, clock in in_order(tuples(rows, ["value", "us", "seq", "clock_us"]), lambda r: r[2]):
            for e in self.function(self.state, {"key": key, "value": whole(value), "ts": from_micros(us, self.zoned), "seq": long(seq)}):
                yield key, e["key"], e["value"], _micros(e["ts"]), e["seq"], long(clock)
        self.state.end()

    def handleInputRows(self, key, rows, timerValues):
        return frames(self._events(whole(key[0]), rows), _OUT)

    def close(self) -> None:
        pass


def _micros(ts: datetime | None) -> int | None:
    if ts is None:
        return None
    delta = ts - from_micros(0, ts.tzinfo is not None)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _bounded(rows: DataFrame, function: ProcessFunction, states: dict[str, tuple], out: str) -> DataFrame:
    """A key's rows stand together and in order, and pass one by one."""

    def run(batches):
        state, now, found = KeyedState(None, states), None, []

        def batch(like):
            types = [like.schema.field(c).type for c in ("key", "key", "value", "ts", "seq", "clock")]
            made = [pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays(made, ["route_key", "key", "value", "ts", "seq", "clock"])

        for b in batches:
            for key, value, ts, seq, clock in zip(*(b.column(c).to_pylist() for c in (*COLUMNS, "clock")), strict=True):
                if now is None or now[0] != key:
                    now = (key,)
                    state.begin(key)
                for e in function(state, {"key": key, "value": value, "ts": ts, "seq": seq}):
                    found.append((key, e["key"], e["value"], e["ts"], e["seq"], clock))
                    if len(found) >= CHUNK:
                        yield batch(b)
            if found:
                yield batch(b)

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, out)


def keyed_process(rows: DataFrame, function: ProcessFunction, states: dict[str, tuple]) -> DataFrame:
    """route_key, key, value, ts, seq, clock of the function's events. An error
    in the function fails the job."""
    ts = rows.schema["ts"].dataType.simpleString()
    clock = F.col("clock") if "clock" in rows.columns else F.lit(None)
    rows = rows.select(*COLUMNS, clock.cast(ts).alias("clock"))
    if not rows.isStreaming:
        return _bounded(rows, function, states, f"route_key string, key string, value string, ts {ts}, seq long, clock {ts}")
    use_rocksdb(rows.sparkSession)
    # Times and numbers go as whole numbers without nulls, which pandas keeps exact.
    number = lambda c: F.coalesce(c, F.lit(NULL)).alias
    rows = rows.select("key", "value", number(epoch_us("ts"))("us"), number(F.col("seq"))("seq"), number(epoch_us("clock"))("clock_us"))
    out = "route_key string, key string, value string, us long, seq long, clock_us long"
    found = rows.groupBy("key").transformWithStateInPandas(statefulProcessor=_Processor(function, states, ts == "timestamp"), outputStructType=out, outputMode="Update", timeMode="None")
    at = lambda c: F.timestamp_micros(c).cast(ts).alias
    return found.select("route_key", "key", "value", at("us")("ts"), "seq", at("clock_us")("clock"))


def dedup_function(state: KeyedState, event: dict) -> Iterator[dict]:
    """Drops a value its key has seen. State: {"seen": ("map", "value string", "flag boolean")}."""
    seen = state["seen"]
    if not seen.get(event["value"])[1]:
        seen.put(event["value"], True)
        yield event


DEDUP_STATE = {"seen": ("map", "value string", "flag boolean")}


def running_count_function(state: KeyedState, event: dict) -> Iterator[dict]:
    """Writes `<value> count=<n>`. State: {"count": ("value", "n long")}."""
    n = (state["count"].get()[0] or 0) + 1
    state["count"].set(n)
    yield event | {"value": f"{event['value']} count={n}"}


COUNT_STATE = {"count": ("value", "n long")}

"""Rows of one key of a stream's batch: put in order and passed on in bounded
memory, between pandas frames and tuples."""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd

#: A whole number that stands for null.
NULL = -(2**63)
#: Rows of a frame or block, and rows that are put in order in memory.
CHUNK, RUN = 10_000, 200_000

_EPOCH = datetime(1970, 1, 1)
_ZONED = _EPOCH.replace(tzinfo=timezone.utc)


def long(x: int) -> int | None:
    return None if x == NULL else int(x)


def whole(x):
    """Null as None."""
    return None if x is None or x != x else x


def from_micros(us: int, zoned: bool = False) -> datetime | None:
    return None if us == NULL else (_ZONED if zoned else _EPOCH) + timedelta(microseconds=int(us))


def tuples(frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    for f in frames:
        yield from zip(*(f[c].tolist() for c in columns), strict=True)


def frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= CHUNK:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def in_order(rows: Iterable[tuple], place: Callable[[tuple], object], run: int = RUN) -> Iterator[tuple]:
    """The rows by place, equal ones as they came. More than `run` of them are
    sorted in runs on the machine's scratch disk, which are then merged."""
    held, runs, file = [], [], None
    for row in rows:
        held.append(row)
        if len(held) >= run:
            held.sort(key=place)
            file = file or tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            runs.append(_write(file, held))
            held = []
    held.sort(key=place)
    if not runs:
        yield from held
        return
    with file:
        yield from heapq.merge(*(_read(file, r) for r in runs), held, key=place)


#: Rows of a block of a run, of which a merge holds one of each run.
_BLOCK = 1_000


def _write(file, rows: list[tuple]) -> list[tuple[int, int]]:
    blocks = []
    for i in range(0, len(rows), _BLOCK):
        raw = pickle.dumps(rows[i : i + _BLOCK], pickle.HIGHEST_PROTOCOL)
        blocks.append((file.tell(), len(raw)))
        file.write(raw)
    return blocks


def _read(file, blocks: list[tuple[int, int]]) -> Iterator[tuple]:
    for at, size in blocks:
        file.seek(at)
        yield from pickle.loads(file.read(size))

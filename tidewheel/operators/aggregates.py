"""Aggregates: a Spark column for set-based plans, and the same as a fold for
keyed state. The set is open: `custom` takes any aggregate column."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import float_text, number


@dataclass(frozen=True)
class Aggregate:
    name: str
    column: Callable[[], Column]  # one aggregate function over the event columns
    type: str
    text: Callable[[Column], Column]
    add: Callable[[Any, Any], Any] | None = None  # (state, value) -> state, with state None at first
    merge: Callable[[Any, Any], Any] | None = None
    combine: Callable[[Column], Column] | None = None  # an aggregate function over results of parts

    @property
    def foldable(self) -> bool:
        return self.add is not None and self.merge is not None


_DECIMAL = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.ASCII)
_HEX = re.compile(r"[+-]?0x([0-9a-f]*)\.?([0-9a-f]*)p[+-]?\d+", re.ASCII | re.IGNORECASE)
_SPECIAL = re.compile(r"[+-]?inf(inity)?|nan", re.IGNORECASE)


def parse_number(value: str | None) -> float:
    """What `number` does, in Python; 0 if it gives null."""
    if value is None:
        return 0.0
    if _SPECIAL.fullmatch(value):
        return float(value)
    if (found := _HEX.fullmatch(value)) and 0 < len(digits := found[1] + found[2]) and len(digits.lstrip("0")) <= 13:
        try:
            return float.fromhex(value)
        except OverflowError:
            return 0.0
    x = float(value) if _DECIMAL.fullmatch(value) else 0.0
    return x if math.isfinite(x) else 0.0


def count() -> Aggregate:
    """Number of events."""
    return Aggregate("count", lambda: F.count(F.lit(1)), "bigint", lambda x: x.cast("string"), lambda s, _: (s or 0) + 1, lambda a, b: (a or 0) + (b or 0), F.sum)


def total() -> Aggregate:
    """Sum of the values that parse as numbers; others add 0."""
    return Aggregate("sum", lambda: F.sum(F.coalesce(number(F.col("value")), F.lit(0.0))), "double", float_text, lambda s, v: (s or 0.0) + parse_number(v), lambda a, b: (a or 0.0) + (b or 0.0), F.sum)


def custom(name: str, column: Callable[[], Column], type: str, add=None, merge=None, combine=None) -> Aggregate:
    """An aggregate of one's own. Without add and merge it serves tumbling and
    sliding windows of bounded and native jobs only; with combine the sessions of
    a hot key are summed up in parts."""
    return Aggregate(name, column, type, lambda x: x.cast("string"), add, merge, combine)

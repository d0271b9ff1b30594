"""Window assigners. Windows are half-open and aligned to 1970; times before it
are floored. A size, slide or gap that is not positive assigns no window."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import epoch_us, from_us, micros


@dataclass(frozen=True)
class Tumbling:
    size: timedelta | int | float | str

    @property
    def size_us(self) -> int:
        return micros(self.size)

    @property
    def slide_us(self) -> int:
        return self.size_us

    def panes(self, ts_us: int) -> list[tuple[int, int]]:
        size = self.size_us
        return [(ts_us // size * size, ts_us // size * size + size)] if size > 0 else []

    def explode(self, rows: DataFrame) -> DataFrame:
        """One row per row and window, with window_start and window_end."""
        if self.size_us <= 0:
            return _none(rows)
        at = rows.withColumn("us", epoch_us("ts"))
        start = F.col("us") - F.pmod(F.col("us"), F.lit(self.size_us))
        return at.withColumn("window_start", from_us(start)).withColumn("window_end", from_us(start + self.size_us)).drop("us")


@dataclass(frozen=True)
class Sliding:
    size: timedelta | int | float | str
    slide: timedelta | int | float | str

    @property
    def size_us(self) -> int:
        return micros(self.size)

    @property
    def slide_us(self) -> int:
        return micros(self.slide)

    def panes(self, ts_us: int) -> list[tuple[int, int]]:
        size, slide = self.size_us, self.slide_us
        if size <= 0 or slide <= 0:
            return []
        last = ts_us // slide * slide
        first = last - (size - 1) // slide * slide
        return [(s, s + size) for s in range(first, last + 1, slide) if s <= ts_us < s + size]

    def explode(self, rows: DataFrame) -> DataFrame:
        """As Tumbling's; a slide over the size leaves gaps in which a row has no
        window at all."""
        size, slide = self.size_us, self.slide_us
        if size <= 0 or slide <= 0:
            return _none(rows)
        at = rows.withColumn("us", epoch_us("ts"))
        last = F.col("us") - F.pmod(F.col("us"), F.lit(slide))
        first = last - (size - 1) // slide * slide
        at = at.withColumn("start", F.explode(F.sequence(first, last, F.lit(slide).cast("long")))).where(F.col("start") + size > F.col("us"))
        return at.withColumn("window_start", from_us(F.col("start"))).withColumn("window_end", from_us(F.col("start") + size)).drop("us", "start")


@dataclass(frozen=True)
class Session:
    gap: timedelta | int | float | str

    @property
    def gap_us(self) -> int:
        return micros(self.gap)

    def panes(self, ts_us: int) -> list[tuple[int, int]]:
        return [(ts_us, ts_us + self.gap_us)] if self.gap_us > 0 else []


def _none(rows: DataFrame) -> DataFrame:
    nothing = F.lit(None).cast("timestamp_ntz")
    return rows.where(F.lit(False)).withColumn("window_start", nothing).withColumn("window_end", nothing)


Assigner = Tumbling | Sliding | Session


def merges(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Windows that touch merge as well."""
    return a[0] <= b[1] and b[0] <= a[1]


__all__ = ["Assigner", "Session", "Sliding", "Tumbling", "merges"]

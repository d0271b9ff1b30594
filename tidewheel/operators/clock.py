"""Event-time clocks.

The clock at a row is the largest time of all rows that arrived before it, less
a bound; it belongs to the whole input, not to a key."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import epoch_us, from_us, micros

#: Rows of one bucket of the prefix maximum, about.
BUCKET_ROWS = 1_000_000


def with_clock(rows: DataFrame, bound: timedelta | int | float | str, order: tuple[str, ...] = ("seq",), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add `clock`, null where no row came before.

    A running maximum over all rows would be one task. Rows fall into buckets of
    consecutive `order[0]` instead: one maximum per bucket, a prefix maximum
    over the buckets, and a running maximum inside each. The buckets' table,
    which alone is broadcast, has rows / bucket_rows rows (one is added for
    every gap of a whole bucket that is not empty). Rows without a place
    (order[0] is null) come before all others, as they sort."""
    first = order[0]
    low, high, n = rows.agg(F.min(first), F.max(first), F.count(F.lit(1))).first()
    if not n:
        return rows.withColumn("clock", F.lit(None).cast("timestamp_ntz"))
    buckets = max(1, -(-n // bucket_rows))
    buckets = 1 if low is None else buckets
    width = 1 if low is None else max(1, -(-(high - low + 1) // buckets))
    us = rows.withColumn("__us", epoch_us("ts"))
    inside = W.partitionBy("__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    if buckets == 1:
        with_max = us.withColumn("__bucket", F.lit(0)).withColumn("__max", F.max("__us").over(inside))
    else:
        us = us.withColumn("__bucket", F.coalesce(F.expr(f"({first} - {low}L) div {width}L"), F.lit(-1).cast("long")))
        per = us.groupBy("__bucket").agg(F.max("__us").alias("__top"))
        before = per.select(F.col("__bucket").alias("__b"), F.max("__top").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
        joined = us.join(F.broadcast(before), F.col("__bucket") == F.col("__b"))
        with_max = joined.withColumn("__max", F.greatest(F.max("__us").over(inside), F.col("__before"))).drop("__b", "__before")
    return with_max.withColumn("clock", from_us(F.col("__max") - max(0, micros(bound)))).drop("__us", "__bucket", "__max")


class OutOfOrderClock:
    """The same clock fed one time after another, in microseconds."""

    def __init__(self, bound: timedelta | int | float | str):
        self.bound, self.top, self.now = micros(bound), None, None

    def observe(self, ts_us: int) -> tuple[int | None, bool]:
        """(clock, whether it moved)."""
        self.top = ts_us if self.top is None else max(self.top, ts_us)
        new = self.top - self.bound
        moved = self.now is None or new > self.now
        if moved:
            self.now = new
        return self.now, moved


class InputClocks:
    """The smallest clock of several inputs that have reported, never going back.
    Inputs that have not reported do not hold it."""

    def __init__(self):
        self.inputs: dict[int, int] = {}
        self.now: int | None = None

    def update(self, index: int, clock: int) -> int:
        self.inputs[index] = max(clock, self.inputs.get(index, clock))
        low = min(self.inputs.values())
        self.now = low if self.now is None else max(self.now, low)
        return self.now

    def restore(self, clock: int) -> None:
        self.now = clock

"""Keyed processing of bounded rows as set-based plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dedup(rows: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The first arrival of each (key, value). Taken by a minimum, not by a
    ranking: equal rows combine before the shuffle, so a hot pair is no hot task."""
    others = [c for c in rows.columns if c not in ("key", "value")]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("first")
    return rows.groupBy("key", "value").agg(first).select("key", "value", *[F.col("first")[c].alias(c) for c in others]).select(*rows.columns)


#: Arrival numbers of one slice of running_count, whose rows of a key are put in
#: order together.
SLICE = 1_000_000


def running_count(rows: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Each row with its number within its key as `n`, and as text in value.
    Numbers are counted within slices of order[0] (a whole number; null is the
    first) and go on from what the key had in the slices before, so the rows of a
    hot key are many tasks."""
    part = F.coalesce(F.floor(F.col(order[0]) / SLICE), F.lit(-(2**62)).cast("long"))
    rows = rows.withColumn("__slice", part)
    had = rows.groupBy("key", "__slice").agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(W.partitionBy("key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    had = had.select(F.col("key").alias("__key"), F.col("__slice").alias("__at"), before.alias("__before"))
    n = F.row_number().over(W.partitionBy("key", "__slice").orderBy(*order)).cast("long")
    found = rows.withColumn("n", n).join(had, F.col("key").eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__at")))
    found = found.withColumn("n", F.col("n") + F.col("__before")).drop("__slice", "__key", "__at", "__before")
    return found.withColumn("value", F.concat("value", F.lit(" count="), F.col("n").cast("string")))


def list_state(rows: DataFrame, last: int, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """(key, values): the last values of each key in arrival order. A first pass
    keeps the last ones of each slice of a key (slices by a hash of its rows), so
    the rows of a hot key never stand in one task together."""
    slices = F.pmod(F.xxhash64(*order), F.lit(64)).alias("slice")
    keyed = rows.select("key", "value", F.struct(*order).alias("at"), slices)
    first = keyed.withColumn("back", F.row_number().over(W.partitionBy("key", "slice").orderBy(F.desc("at")))).where(F.col("back") <= last)
    kept = first.withColumn("back", F.row_number().over(W.partitionBy("key").orderBy(F.desc("at")))).where(F.col("back") <= last)
    found = kept.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("back", "value")), asc=False).alias("l"))
    return found.select("key", F.col("l.value").alias("values"))

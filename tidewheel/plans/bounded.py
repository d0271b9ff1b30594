"""Windowed aggregation of bounded rows, exact to the single record.

The clock of a row follows from the rows that arrived before it, so every
decision of a record-at-a-time engine is a column: a row is on time for a
window if the window's end is after its clock, re-fires the window if the clock
is less than `lateness` past the end, and is late otherwise. On-time rows are
grouped with partial aggregation; only windows that re-fire are ordered.

Rows carry key, value, ts and seq; `clock` is added if it is missing."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import epoch_us, from_us, micros
from ..operators.aggregates import Aggregate
from ..operators.clock import with_clock
from ..operators.fold import PaneFold
from ..operators.windows import Assigner, Session

RESULT = ["kind", "key", "window_start", "window_end", "result", "firing", "value", "ts", "seq"]


def classified(rows: DataFrame, assigner: Assigner, lateness: timedelta | int | float | str = 0) -> DataFrame:
    """One row per row and window with `class`: ontime, refire or late."""
    horizon = F.expr(f"window_end + make_dt_interval(0, 0, 0, {max(0, micros(lateness)) / 1e6:.6f})")
    ontime = F.col("clock").isNull() | (F.col("window_end") > F.col("clock"))
    return assigner.explode(rows).withColumn("class", F.when(ontime, "ontime").when(F.col("clock") < horizon, "refire").otherwise("late"))


def windowed(rows: DataFrame, assigner: Assigner, aggregate: Aggregate, bound: timedelta | int | float | str = 5, lateness: timedelta | int | float | str = 0, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """All that a job emits: (kind, key, window_start, window_end, result,
    firing, value, ts, seq). kind `fire` has a result; firing 0 is the window's
    on-time result, n its n-th re-fire. kind `late` is one row per row and
    window it came too late for, with the row's value, ts and seq. Sessions merge,
    so their aggregate must be foldable."""
    if isinstance(assigner, Session) and not aggregate.foldable:
        raise ValueError(f"{aggregate.name} cannot be folded, as sessions need")
    if "clock" not in rows.columns:
        rows = with_clock(rows, bound, order)
    if isinstance(assigner, Session):
        return _sessions(rows, assigner, aggregate, lateness, order)
    panes = classified(rows, assigner, lateness)
    keys = ["key", "window_start", "window_end"]
    fires = panes.where("class = 'ontime'").groupBy(*keys).agg(aggregate.column().alias("result"))
    out = _fires(fires.withColumn("firing", F.lit(0).cast("long")), aggregate).unionByName(_lates(panes.where("class = 'late'")))
    if micros(lateness) <= 0:
        return out
    touched = panes.where("class = 'refire'").select(*keys).distinct()
    again = panes.where("class <> 'late'").join(touched, keys, "left_semi")
    upto = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    again = again.select(*keys, "class", aggregate.column().over(upto).alias("result"), F.sum(F.when(F.col("class") == "refire", 1).otherwise(0)).over(upto).alias("firing"))
    return out.unionByName(_fires(again.where("class = 'refire'"), aggregate))


def window_results(rows: DataFrame, *args, **kwargs) -> DataFrame:
    """Only the fired results: (key, window_start, window_end, result, firing)."""
    return windowed(rows, *args, **kwargs).where("kind = 'fire'").select("key", "window_start", "window_end", "result", "firing")


def late_rows(rows: DataFrame, *args, **kwargs) -> DataFrame:
    """Only the side output: (key, value, ts, seq, window_start, window_end)."""
    return windowed(rows, *args, **kwargs).where("kind = 'late'").select("key", "value", "ts", "seq", "window_start", "window_end")


def _fires(frame: DataFrame, aggregate: Aggregate) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return frame.select(F.lit("fire").alias("kind"), "key", "window_start", "window_end", F.col("result").cast(aggregate.type).alias("result"), F.col("firing").cast("long").alias("firing"), null("string").alias("value"), null("timestamp_ntz").alias("ts"), null("long").alias("seq")).select(*RESULT)


def _lates(frame: DataFrame, result_type: str = "void") -> DataFrame:
    return frame.select(F.lit("late").alias("kind"), "key", "window_start", "window_end", F.lit(None).alias("result"), F.lit(None).cast("long").alias("firing"), "value", "ts", "seq").select(*RESULT)


#: A key's rows are put in order by stretches of so many session gaps.
STRETCH_GAPS = 256


def _runs(at: DataFrame, gap: int, order: tuple[str, ...]) -> DataFrame:
    """Number the runs of a key's rows (us) that lie no more than `gap` apart
    within one stretch of time. A hot key is many tasks."""
    at = at.withColumn("stretch", F.floor(F.col("us") / (gap * STRETCH_GAPS)))
    along = W.partitionBy("key", "stretch").orderBy("us", *order)
    at = at.withColumn("opens", F.coalesce(F.col("us") - F.lag("us").over(along) > gap, F.lit(True)).cast("int"))
    return at.withColumn("run", F.sum("opens").over(along.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("opens")


def _islands(runs: DataFrame, gap: int) -> DataFrame:
    """Number what runs on from one stretch into the next: one row for each run."""
    after = W.partitionBy("key").orderBy("first")
    runs = runs.withColumn("opens", F.coalesce(F.col("first") - F.lag("last").over(after) > gap, F.lit(True)).cast("long"))
    return runs.withColumn("island", F.sum("opens").over(after.rowsBetween(W.unboundedPreceding, 0))).drop("opens")


def _of_runs(at: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of some runs, with their island."""
    of = runs.select(F.col("key").alias("__key"), F.col("stretch").alias("__stretch"), F.col("run").alias("__run"), "island")
    found = at.join(of, F.col("key").eqNullSafe(F.col("__key")) & (F.col("stretch") == F.col("__stretch")) & (F.col("run") == F.col("__run")))
    return found.drop("__key", "__stretch", "__run")


def _sessions(rows: DataFrame, assigner: Session, aggregate: Aggregate, lateness, order: tuple[str, ...]) -> DataFrame:
    """Rows of a key whose windows touch form an island; sessions of different
    islands never meet. In an island without a row at or behind its clock, every
    merge finds a live session, so the island is one session: a plain grouping.
    Only the other islands are folded row by row."""
    gap = assigner.gap_us
    if gap <= 0:
        return _fires(rows.where(F.lit(False)).select("key", F.col("ts").alias("window_start"), F.col("ts").alias("window_end"), F.lit(None).alias("result"), F.lit(0).alias("firing")), aggregate)
    at = _runs(rows.withColumn("us", epoch_us("ts")), gap, order)
    behind = F.max(F.coalesce(F.col("ts") <= F.col("clock"), F.lit(False))).alias("behind")
    result = [aggregate.column().alias("result")] if aggregate.combine else []
    runs = _islands(at.groupBy("key", "stretch", "run").agg(behind, F.min("us").alias("first"), F.max("us").alias("last"), *result), gap)
    ends = [F.max("behind").alias("behind"), F.min("first").alias("s"), F.max("last").alias("e")]
    if aggregate.combine:
        plain = runs.groupBy("key", "island").agg(*ends, aggregate.combine(F.col("result")).alias("result"))
    else:
        whole = _of_runs(at, runs).withColumn("first", F.col("us")).withColumn("last", F.col("us"))
        whole = whole.withColumn("behind", F.coalesce(F.col("ts") <= F.col("clock"), F.lit(False)))
        plain = whole.groupBy("key", "island").agg(*ends, aggregate.column().alias("result"))
    fires = plain.where(~F.col("behind")).select("key", from_us(F.col("s")).alias("window_start"), from_us(F.col("e") + gap).alias("window_end"), "result", F.lit(0).alias("firing"))
    out = _fires(fires, aggregate)
    late = W.partitionBy("key", "island")
    odd = _of_runs(at, runs.withColumn("behind", F.max("behind").over(late)).where("behind"))
    # An island's rows stand together and in order, and are folded as they pass.
    odd = odd.select("key", "island", "value", "ts", "seq", "us", epoch_us("clock").alias("clock_us"), *[F.col(c).alias(f"at{i}") for i, c in enumerate(order)])
    odd = odd.repartition("key", "island").sortWithinPartitions("key", "island", *[f"at{i}" for i in range(len(order))])
    fold_lateness = micros(lateness)
    names = ["kind", "key", "s", "e", "result", "firing", "value", "ts", "seq"]

    def fold(frames):
        now, state = None, None
        for pdf in frames:
            found = []
            for key, island, value, ts, seq, us, clock in zip(*(pdf[c] for c in ("key", "island", "value", "ts", "seq", "us", "clock_us")), strict=True):
                if (key, island) != now:
                    if state is not None:
                        found += [(kind, now[0], s, e, r, n, None, None, None) for kind, s, e, r, n in state.advance(2**62)]
                    now, state = (key, island), PaneFold(assigner, aggregate, fold_lateness)
                for kind, s, e, r, n in state.add(int(us), value, None if pd.isna(clock) else int(clock)):
                    found.append((kind, key, s, e, r, n) + ((value, ts, seq) if kind == "late" else (None, None, None)))
            yield pd.DataFrame(found, columns=names).astype({"seq": "Int64", "firing": "Int64"})
        if state is not None:
            found = [(kind, now[0], s, e, r, n, None, None, None) for kind, s, e, r, n in state.advance(2**62)]
            yield pd.DataFrame(found, columns=names).astype({"seq": "Int64", "firing": "Int64"})

    schema = f"kind string, key string, s long, e long, result {aggregate.type}, firing long, value string, ts timestamp_ntz, seq long"
    folded = odd.mapInPandas(fold, schema)
    return out.unionByName(folded.select("kind", "key", from_us(F.col("s")).alias("window_start"), from_us(F.col("e")).alias("window_end"), "result", "firing", "value", "ts", "seq").select(*RESULT))

"""Windows by Spark's own watermark, which moves once per micro-batch.

The cheapest tier: partial aggregation before the shuffle, state kept and
evicted by Spark. Results equal the exact ones where batches are small or
input is in order; late rows are dropped by Spark and counted in its progress."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import micros
from ..operators.aggregates import Aggregate
from ..operators.windows import Assigner, Session, Sliding
from .state import use_rocksdb


def configure(spark: SparkSession) -> None:
    """Settings a streaming job wants: state on disk, and late rows judged by
    the watermark of their own batch (plans here have one stateful operator)."""
    use_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")


def native_windows(stream: DataFrame, assigner: Assigner, aggregate: Aggregate, bound: timedelta | int | float | str = 5) -> DataFrame:
    """(key, window_start, window_end, result) of a stream of key, value, ts."""
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{micros(bound)} microseconds")
    interval = lambda us: f"{us} microseconds"
    if isinstance(assigner, Session):
        window = F.session_window("ts", interval(assigner.gap_us))
    elif isinstance(assigner, Sliding):
        if assigner.slide_us > assigner.size_us:
            raise ValueError("a slide over the window size needs the exact tier")
        window = F.window("ts", interval(assigner.size_us), interval(assigner.slide_us))
    else:
        window = F.window("ts", interval(assigner.size_us))
    found = rows.groupBy("key", window.alias("w")).agg(aggregate.column().alias("result"))
    return found.select("key", F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"), "result")


def pending_windows(spark: SparkSession, checkpoint: str, aggregate: Aggregate) -> DataFrame:
    """(key, window_start, window_end, result) of the tumbling or sliding windows
    that a stopped native job still held: read from the state it left, from which
    Spark removes a window when it is given out."""
    state = spark.read.format("statestore").load(checkpoint)
    names, buffers = state.schema["key"].dataType.names, state.schema["value"].dataType.names
    if len(names) != 2 or len(buffers) != 1:
        raise ValueError("only windows of one-value aggregates can be read from their state")
    window = F.col(f"key.{names[1]}")
    return state.select(F.col(f"key.{names[0]}").alias("key"), window["start"].cast("timestamp_ntz").alias("window_start"), window["end"].cast("timestamp_ntz").alias("window_end"), F.col(f"value.{buffers[0]}").cast(aggregate.type).alias("result"))

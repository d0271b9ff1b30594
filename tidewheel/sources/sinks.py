"""Sinks for streaming and bounded results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BatchSink = Callable[[DataFrame, int], None]


def stdout_lines(frame: DataFrame) -> DataFrame:
    """`HH:MM:SS.mmm key=… value=…` for each row."""
    return frame.select(F.concat(F.date_format("ts", "HH:mm:ss.SSS"), F.lit(" key="), F.col("key"), F.lit(" value="), F.col("value")).alias("line"))


def console_sink(write: Callable[[str], object] = print) -> BatchSink:
    """Print a batch's lines on the driver; meant for demos, row by row."""
    if write is None:
        raise ValueError("console sink has no writer")

    def sink(batch: DataFrame, batch_id: int) -> None:
        for r in stdout_lines(batch).toLocalIterator():
            write(r["line"])

    return sink


def idempotent(path: str) -> BatchSink:
    """Write each batch as Parquet under its own number: a batch that is run
    again after a crash replaces what it wrote, so results appear once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sink


def split_late(main: BatchSink, side: BatchSink | None = None) -> BatchSink:
    """Send `late` rows to the side output and all others to the main sink. An
    error in either fails the query at once."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        if side is None:
            main(batch.where("kind <> 'late'"), batch_id)
            return
        batch.persist()
        try:
            main(batch.where("kind <> 'late'"), batch_id)
            side(batch.where("kind = 'late'"), batch_id)
        finally:
            batch.unpersist()

    return sink

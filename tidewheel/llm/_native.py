"""Column expressions shared by the operators that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
SPACE_RUN = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; 0 for null.

    Splitting at white space gives one more part than there are gaps, and an
    empty one at an end that is white space."""
    ends = F.substring(text, 1, 1).isin(SPACES).cast("long") + F.substring(text, -1, 1).isin(SPACES).cast("long")
    return F.when(text.isNull() | (text == ""), F.lit(0).cast("long")).otherwise(F.size(F.split(text, SPACE_RUN)).cast("long") - ends)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), n), "")


def small_side(frame: DataFrame, max_rows: int) -> DataFrame:
    """`frame` (already materialised) marked for broadcast if it has at most
    max_rows rows; else as it is, for a shuffled join."""
    return F.broadcast(frame) if frame.limit(max_rows + 1).count() <= max_rows else frame

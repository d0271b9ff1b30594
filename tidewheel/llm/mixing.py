"""Mixing sources to target weights.

Each row gets a hash-random key. Within each source rows are taken in key order
up to the source's exact budget of words, over as many epochs as that needs.
The order is never made as a whole: keys fall into ranges, per-range sums give
distributed prefix sums, and only the one range of a source in which its budget
ends is sorted. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import cut, fresh
from ._native import first_words, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
RANGE_ROWS = 20_000


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Sources in code
    point order, null last, take the weights in turn and share `share` times all
    words; a target stops at max_epochs times its source, and what it leaves is
    shared by weight among the others until none is above (water filling, solved
    by prefix sums over sources in the order in which they fill up)."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    fill = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    level = (total * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level).withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    rows = rows.withColumn("at", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("at") * F.col("w")).alias("target"))


def _key(id_col: str, text_col: str) -> Column:
    """A hash-random key of a row; only rows of one id and one text share it."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary"))


def _taken(docs: DataFrame, weights, share: float, max_epochs: int, range_rows: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_count(F.col(text_col).cast("string")).alias("size"), F.col(source_col).cast("string").alias("source"), _key(id_col, text_col).alias("key"))
    rows = cut(rows)
    ranges = max(1, -(-rows.count() // range_rows))
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("range", F.shiftright(head * ranges, 32).cast("int"))

    per_range = cut(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")))
    goal = targets(per_range.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, max_epochs)
    goal = goal.withColumn("budget", F.floor("target")).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0).cast("long")))
    goal = goal.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    before = F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    state = per_range.withColumn("before", before).alias("p").join(goal.alias("g"), F.expr("p.source <=> g.source")).select(F.col("p.source").alias("s"), F.col("p.range").alias("r"), "range_size", "before", "source_size", "target", "epochs", "rest")
    state = cut(state)

    out = rows.join(state, F.expr("source <=> s and range = r"))
    inside = F.expr("before < rest and before + range_size > rest")
    whole = F.when(F.expr("before + range_size <= rest"), F.col("size")).otherwise(F.lit(0).cast("long"))
    plain = out.where(~inside).withColumn("part", whole)
    # The range in which a budget ends has about range_rows rows at most.
    run = W.partitionBy("s", "r").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("size").over(run), F.lit(0).cast("long"))
    edge = out.where(inside).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return plain.unionByName(edge).withColumn("taken", F.col("epochs") * F.col("size") + F.col("part"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) of every row of `docs`.

    size: words of the text, 0 for null. taken: words the mix takes, epochs
    counted; each source's sum is its target rounded down, so at most one row of
    a source is taken in part. A null source is a source. Keys hash id and text,
    so reruns agree, and rows of one id (or of none) are spread by their texts.
    An empty table gives no rows; a source without words has target 0."""
    return _taken(docs, weights, share, max_epochs, range_rows, id_col, text_col, source_col).select("doc_id", "size", "source", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The documents of the mix, with all their columns: one row for each whole
    epoch of a document, and the first words of the one row at which a source's
    budget ends. Rows without words are not taken. Each row is taken on its own,
    also where ids repeat; rows equal in id, text and source are interchangeable.
    An empty table stays empty; other columns may have any names."""
    key, at, source, size, n, have, want, words = fresh(docs, "mix_key", "mix_at", "mix_source", "mix_size", "mix_taken", "mix_have", "mix_want", "mix_words")
    taken = _taken(docs, weights, share, max_epochs, range_rows, id_col, text_col, source_col)
    taken = cut(taken.where("size > 0").select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.col("taken").alias(n)))
    rows, same = docs.withColumn(at, _key(id_col, text_col)), F.col(at) == F.col(key)
    if not taken.groupBy(key).count().where("count > 1").isEmpty():
        number = lambda frame, of, by, to: frame.withColumn(to, F.row_number().over(W.partitionBy(of).orderBy(F.col(by).cast("string"))))
        rows, taken = number(rows, at, source_col, have), number(taken, key, source, want)
        same = same & (F.col(have) == F.col(want))
    taken = taken.where(F.col(n) > 0)
    parts = F.transform(F.sequence(F.lit(1), F.ceil(F.col(n) / F.col(size)).cast("int")), lambda i: F.least(F.col(size), F.col(n) - (i - 1) * F.col(size)).cast("int"))
    out = rows.join(taken.hint("shuffle_hash"), same).withColumn(words, F.explode(parts))
    whole = F.col(words) == F.col(size)
    out = out.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(words))))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(whole, F.col(chars_col)).otherwise(F.length(text_col).cast(docs.schema[chars_col].dataType)))
    return out.select(*docs.columns)

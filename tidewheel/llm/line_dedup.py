"""Removal of lines that stand on many sites.

A HyperLogLog sketch of the sites of each line is built and merged by the
aggregation on the line's hash, so a line in a third of all documents costs one
small sketch per task. Lines whose estimate is near the threshold get an exact
distinct count. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import cut
from ._native import small_side

MIN_SITES = 5
LOG_K = 12
#: Three standard errors of a sketch of 2**12 registers, and a line at least.
NEAR = 0.05
SMALL = 50_000


def _lines(rows: DataFrame) -> DataFrame:
    """Each line with a character that is not white space, by two hashes."""
    lines = rows.select("id", "print", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("id", "print", "site", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def boilerplate(rows: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2) of the lines that stand on at least `min_sites` sites."""
    lines = _lines(rows)
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_K)).alias("sketch"), F.count("*").alias("n"))
    margin = max(1, -(-int(min_sites * NEAR * 100) // 100))
    found = sketched.where(F.col("n") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    found = cut(found.where(F.col("sites") >= min_sites - margin))
    sure = found.where(F.col("sites") > min_sites + margin).select("h1", "h2")
    near = found.where(F.col("sites") <= min_sites + margin).select("h1", "h2")
    exact = lines.join(small_side(near, SMALL), ["h1", "h2"]).select("h1", "h2", "site").distinct().groupBy("h1", "h2").count()
    return cut(sure.unionByName(exact.where(F.col("count") >= min_sites).select("h1", "h2")))


def drop_shared_lines(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each text without the lines (cut at
    \\n, compared as they are) that stand on at least `min_sites` sites.

    n_lines counts the lines that are not blank; blank ones stay. A null site is
    a site of its own. A null text stays null, with 0 lines. Rows with equal id
    and text share their result; null ids are allowed. Other columns are
    ignored."""
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("null"))
    text = F.col(text_col).cast("string")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text).alias("print"), site.alias("site"), text.alias("text"))
    bad = boilerplate(rows, min_sites)
    hits = _lines(rows).join(small_side(bad, SMALL), ["h1", "h2"]).groupBy("id", "print").agg(F.array_sort(F.collect_set("pos")).alias("bad"))
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).withColumn("print", F.xxhash64("text"))
    out = full.join(hits, ["id", "print"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.expr("array_join(transform(array_except(sequence(0, size(lines) - 1), bad), i -> lines[i]), '\n')"))
    n_lines = F.coalesce(F.expr(r"size(filter(lines, x -> x rlike '[^\\x20\\x09-\\x0D]'))"), F.lit(0))
    return out.select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"), F.coalesce(F.size("bad"), F.lit(0)).cast("long").alias("n_removed"), kept.alias("text"))

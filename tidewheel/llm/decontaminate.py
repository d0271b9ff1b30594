"""Benchmark decontamination by greedy string tiling.

Windows of `min_match` words that a document and a benchmark item share are
seeds. For each pair whose seeds could cover enough of the item, the longest
common runs of words are marked first and again and again, without overlap in
either text (Karp-Rabin fingerprints find the runs, word hashes confirm them).
The tiles' share of the item's words is its coverage, so reordered passages
count as well. A document that covers enough of any item is contaminated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import batched, fresh
from ._text import Words, buffers, mix, row_blocks

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK = 2 << 20
#: A benchmark of up to this many bytes of text goes to every executor whole;
#: a larger one is joined.
BROADCAST_BYTES = 16 << 20

_KR = np.uint64(0x2545F4914F6CDD1D)


def fingerprints(hashes: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin fingerprints of all windows of n words, modulo 2**64."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):  # Horner's rule over all windows at once
        out = out * _KR + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def tiles(text: np.ndarray, item: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words) between two sequences
    of word hashes, longest first; ties go to the smaller place in the item."""
    ft, fi = fingerprints(text, min_match), fingerprints(item, min_match)
    if not len(ft) or not len(fi):
        return []
    order = np.argsort(ft, kind="stable")
    low, high = np.searchsorted(ft[order], fi, "left"), np.searchsorted(ft[order], fi, "right")
    n = high - low
    p = np.repeat(np.arange(len(fi)), n)
    t = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    same = np.ones(len(p), bool)
    for k in range(min_match):
        same &= text[t + k] == item[p + k]
    p, t = p[same], t[same]
    out, used_t, used_p = [], np.zeros(len(text), bool), np.zeros(len(item), bool)
    while len(p):
        along = np.lexsort((p, t - p))
        p, t = p[along], t[along]
        head = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 1) | (np.diff(t) != 1))))
        length = np.diff(np.concatenate((head, [len(p)]))) + min_match - 1
        longest = int(length.max())
        runs = head[length == longest]
        for r in runs[np.lexsort((t[runs], p[runs]))]:
            a, b = int(t[r]), int(p[r])
            if not used_t[a : a + longest].any() and not used_p[b : b + longest].any():
                used_t[a : a + longest] = used_p[b : b + longest] = True
                out.append((a, b, longest))
        taken_t, taken_p = np.concatenate(([0], np.cumsum(used_t))), np.concatenate(([0], np.cumsum(used_p)))
        free = (taken_t[t + min_match] == taken_t[t]) & (taken_p[p + min_match] == taken_p[p])
        p, t = p[free], t[free]
    return out


class Index:
    """Benchmark items by their windows."""

    def __init__(self, ids: list, texts: pa.Array, min_match: int):
        data, offsets = buffers(texts)
        words = Words(data, offsets, lower=True)
        self.ids, self.min_match = ids, min_match
        self.items = [words.hashes[words.first[i] : words.first[i + 1]] for i in range(len(ids))]
        prints = [fingerprints(x, min_match) for x in self.items]  # repeats count by place
        keys = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(prints)), [len(x) for x in prints])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.distinct = np.unique(self.keys)

    def judge(self, words: Words, coverage: float):
        """For each text: None, or (item number, coverage, tiles, items) with the
        best covered of the items that reach `coverage`."""
        prints, n = fingerprints(words.hashes, self.min_match), len(words.first) - 1
        out: list = [None] * n
        if not len(prints) or not len(self.distinct):
            return out
        pos = np.minimum(np.searchsorted(self.distinct, prints), len(self.distinct) - 1)
        hit = np.flatnonzero(self.distinct[pos] == prints)
        doc = np.searchsorted(words.first, hit, "right") - 1
        inside = hit + self.min_match <= words.first[doc + 1]
        hit, doc = hit[inside], doc[inside]
        for i in np.unique(doc).tolist():
            seeds = np.unique(prints[hit[doc == i]])
            low, high = np.searchsorted(self.keys, seeds, "left"), np.searchsorted(self.keys, seeds, "right")
            owners = np.concatenate([self.owner[a:b] for a, b in zip(low, high, strict=True)])
            best, count = None, 0
            for k, shared in zip(*np.unique(owners, return_counts=True), strict=True):
                item = self.items[k]
                if shared * self.min_match < coverage * len(item):
                    continue
                found = tiles(words.hashes[words.first[i] : words.first[i + 1]], item, self.min_match)
                share = sum(x[2] for x in found) / len(item)
                if share >= coverage:
                    count += 1
                    if best is None or (-share, self.ids[k]) < (-best[1], self.ids[best[0]]):
                        best = (int(k), share, len(found))
            if best is not None:
                out[i] = (*best, count)
        return out


def _judged(column, index: Index, coverage: float) -> list:
    data, offsets = buffers(column)
    out = []
    for lo, hi in row_blocks(offsets, BLOCK):
        out += index.judge(Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True), coverage)
    return out


OUT = "doc_id long, kept boolean, item_id long, coverage double, n_tiles long, n_items long"


def _columns(ids, found: list, names: list):
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([x is None for x in found]), *(pa.array([None if x is None else f(x) for x in found], kind) for f, kind in ((lambda x: names[x[0]], pa.int64()), (lambda x: x[1], pa.float64()), (lambda x: x[2], pa.int64()), (lambda x: x[3], pa.int64())))],
        names=["doc_id", "kept", "item_id", "coverage", "n_tiles", "n_items"],
    )


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("item_text")).where("item_id is not null and item_text is not null")


def _small_index(items: DataFrame, min_match: int, limit: int) -> Index | None:
    """The index of a benchmark within the size bound, else None."""
    if (items.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0) > limit:
        return None
    rows = sorted((r["item_id"], r["item_text"]) for r in items.collect())
    return Index([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()), min_match)


def _windows(min_match: int, distinct: bool):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK):
                words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
                own = [fingerprints(words.hashes[words.first[i] : words.first[i + 1]], min_match) for i in range(hi - lo)]
                own = [np.unique(x) for x in own] if distinct else own
                n = [len(x) for x in own]
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), n)))
                size = pa.array(np.repeat(np.diff(words.first), n))
                yield pa.RecordBatch.from_arrays([ids, size, pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))], names=["id", "size", "print"])

    return run


def _row_key(id_col: str, text_col: str) -> Column:
    """A key of rows with one id (or none) and one text; only such rows share it."""
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("binary"))


def _joined(docs: DataFrame, items: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """Contaminated (key, ...) of rows (key, text) by a join of windows, for a
    benchmark of any size."""
    seeds = items.select("item_id", "item_text").mapInArrow(_windows(min_match, False), "id long, size long, print long").select(F.col("id").alias("item_id"), F.col("size").alias("item_size"), "print")
    docs = docs.dropDuplicates(["id"])
    mine = docs.mapInArrow(_windows(min_match, True), "id string, size long, print long").select("id", "print")
    pairs = mine.join(seeds, "print").groupBy("id", "item_id", "item_size").agg(F.count("*").alias("shared")).where(F.col("shared") * min_match >= F.col("item_size") * coverage)
    # A text meets all the items it may cover in one row, not once for each.
    near = pairs.select("id", "item_id").join(items, "item_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("item_id", "item_text"))).alias("near"))
    rows = docs.join(near, "id").select("id", "text", F.col("near.item_id").alias("ids"), F.col("near.item_text").alias("texts"))

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column(2)[i].as_py()
                found = _judged(batch.column(1).slice(i, 1), Index(ids, batch.column(3)[i].values, min_match), coverage)
                yield _columns(batch.column(0).slice(i, 1), found, ids)

    found = rows.mapInArrow(run, OUT.replace("doc_id long", "doc_id string")).where("not kept")
    return found.select(F.col("doc_id").alias("key"), "item_id", "coverage", "n_tiles", "n_items")


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, kept, item_id, coverage, n_tiles, n_items) of every row of `docs`.

    kept is false if the text covers at least `coverage` of an item's words;
    item_id is then the best covered item (ties: the smallest id) and n_items
    how many reach it, else they are null. Case of A-Z and the kind of white
    space do not matter. Items and texts under `min_match` words cannot match;
    null texts, null items and an empty benchmark leave rows kept. Each row is
    judged by its own text, also one with a null or repeated doc_id; a benchmark
    over `broadcast_bytes` gives the same verdicts."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = _items(batched(benchmark), item_col, item_text_col)
    index = _small_index(items, min_match, broadcast_bytes)
    if index is None:
        keyed = rows.withColumn("key", _row_key("id", "text"))
        found = _joined(keyed.select(F.col("key").alias("id"), "text"), items, min_match, coverage)
        out = keyed.select("key", F.col("id").alias("doc_id")).join(found, "key", "left")
        return out.select("doc_id", F.col("item_id").isNull().alias("kept"), "item_id", "coverage", "n_tiles", "n_items")

    def run(batches):
        for batch in batches:
            yield _columns(batch.column(0), _judged(batch.column(1), index, coverage), index.ids)

    return rows.mapInArrow(run, OUT)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `docs`, with all their columns, that cover no benchmark item.
    Null and empty texts stay; each row is judged by its own text, also where ids
    are null or repeat; an empty benchmark drops nothing, an empty table stays
    empty. Other columns may have any names. Very long texts are judged whole."""
    items = _items(batched(benchmark), "item_id", "text")
    index = _small_index(items, min_match, broadcast_bytes)
    if index is None:
        key, (bad,) = _row_key(id_col, text_col), fresh(docs, "bad_key")
        found = _joined(docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text")), items, min_match, coverage).select(F.col("key").alias(bad))
        return docs.join(found, key == F.col(bad), "left_anti")
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([x is None for x in _judged(batch.column(at), index, coverage)]))

    return docs.mapInArrow(run, docs.schema)

"""Near-duplicate detection by bottom-k sketches.

One hash function orders the shingles of all documents; a document retains the
SKETCH smallest. Inverted lists of the POSTED smallest retained values give the
pairs of documents that overlap, the SKETCH smallest values of both sketches
together estimate the Jaccard similarity, and survivors are confirmed on full
shingle sets. Documents of equal sets are one class before anything else.

A list of at most LIST_LIMIT classes proposes all its pairs. Longer lists need
no pairs of their own unless two classes share nothing but long lists. Of the
POSTED smallest values of their union, classes at similarity 0.75 share 24 on
average with a deviation of 2.4, so both then have at least 12 posted values in
long lists (five deviations below): such classes are *hot*, and hot classes are compared by an exact prefix filter over their full sets. Each posts
its rarest n - ceil(0.75 n) + 1 shingles by the frequency among hot classes; two
sets at 0.75 must share one of them. Lists of these that are short propose all
pairs again. Long ones are groups of near copies: each member is held against a
few leaders of its lists, and every member that is not in its list's largest
component then is held, on full sets, against all hot classes. A pair of which
neither is such a member lies in one component already, so nothing is left out.
No list is collected beyond the limit and none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batched, cut, drop, fresh, tasks_for
from ._native import small_side
from ._text import Words, buffers, mix, row_blocks, shingle_set
from .components import connected_components

SKETCH = 48
POSTED = 32
LIST_LIMIT = 24
LEADERS = 4
#: A block of the query set that _against holds against all hot classes.
QUERY_BYTES = 16 << 20
#: Ids that may be broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000
#: A full set counts as so many narrow rows when files are dealt out.
SET_ROWS = 20
PERCENT = 75
#: A pair passes the estimate from this share of its union sketch on: five
#: standard deviations of a 48-value sketch below 0.75.
ESTIMATE_FLOOR = 0.44
DEVIATIONS = 5


def _sets(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for lo, hi in row_blocks(offsets, 1 << 20):
            words = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower=True)
            found = [shingle_set(words.hashes[words.first[i] : words.first[i + 1]]) for i in range(hi - lo)]
            yield batch.column(0).slice(lo, hi - lo), found


def _list_column(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def _print(sets: list[np.ndarray], salt: int) -> pa.Array:
    """A fingerprint of each whole set."""
    return pa.array(np.array([mix(x.view(np.uint64), salt).sum(dtype=np.uint64) for x in sets], np.uint64).view(np.int64))


def _signatures(k: int):
    def run(batches):
        for ids, found in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(x) for x in found], pa.int64()), _print(found, 201), _print(found, 202), _list_column([x[:k] for x in found])],
                names=["id", "n", "f1", "f2", "sk"],
            )

    return run


def _full_sets(batches):
    for ids, found in _sets(batches):
        yield pa.RecordBatch.from_arrays([ids, _print(found, 201), pa.array([len(x) for x in found], pa.int64()), _list_column(found)], names=["id", "f1", "n", "full"])


def _full(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The full sets of the texts of some ids (a written table of distinct ones)."""
    few = small_side(ids, BROADCAST_IDS)
    texts = docs.join(few if few is not ids else ids.hint("shuffle_hash"), "id", "left_semi")
    return texts.mapInArrow(_full_sets, "id long, f1 long, n long, full array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose union sketch promises it."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sk").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.withColumn("u", union)
    # A value of the union's k smallest lies in both sketches if in both sets.
    share = F.size(F.array_intersect(F.array_intersect("sa", "sb"), "u")) / F.size("u")
    return both.where(share >= ESTIMATE_FLOOR).select("a", "b")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Pairs whose full sets reach the similarity: 100 * both >= percent * either.
    Of an id with several texts each is tried."""
    pairs = cut(pairs.distinct(), tasks)
    ends = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), tasks)
    full = cut(_full(docs, ends).select("id", "full"), tasks_for(SET_ROWS * ends.count()))
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("full").alias("fa")), "a")
    both = both.join(full.select(F.col("id").alias("b"), F.col("full").alias("fb")), "b")
    shared = F.size(F.array_intersect("fa", "fb"))
    links = cut(both.withColumn("shared", shared).where(f"100L * shared >= {percent}L * (size(fa) + size(fb) - shared)").select("a", "b"), tasks)
    drop(pairs, ends, full)
    return links


def _short_pairs(postings: DataFrame, lists: DataFrame, limit: int) -> DataFrame:
    """All pairs of each list of 2 to `limit` members."""
    short = postings.join(lists.where(F.col("c") <= limit).select("v"), "v")
    members = short.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("l"))
    pairs = F.expr(
        "flatten(transform(l, (x, i) -> transform(filter(slice(l, i + 2, size(l)), y -> y.id > x.id"
        f" and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)), y -> struct(x.id as a, y.id as b))))"
    )
    return members.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def _prefixes(held: DataFrame) -> DataFrame:
    """(id, n, v): the rarest shingles of each full set, as many as a set at the
    similarity cannot do without."""
    each = held.select("id", "f1", "n", F.explode("full").alias("v"))
    ranked = each.join(each.groupBy("v").agg(F.count("*").alias("c")), "v").groupBy("id", "f1", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("o"))
    first = F.expr(f"slice(o, 1, cast(n - ({PERCENT} * n + 99) div 100 + 1 as int))")
    return ranked.select("id", "n", F.explode(first).alias("x")).select("id", "n", "x.v")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of each member of long lists and the leaders of its lists."""
    met = members.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("leads"))).alias("leads"))
    met = met.select("id", F.explode("leads").alias("lead")).where("id != lead")
    return met.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))


def _hot_pairs(held: DataFrame, tasks: int, set_tasks: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs among full sets, and the members (v, id) of long lists."""
    prefixes = cut(_prefixes(held), set_tasks)
    # Leaders are drawn by one hash of the id, so lists of one group share them.
    draws = [F.min(F.struct(F.xxhash64("id", F.lit(seed)), "id"))["id"] for seed in range(LEADERS)]
    lists = cut(prefixes.groupBy("v").agg(F.count("*").alias("c"), F.array_distinct(F.array(*draws)).alias("leads")).where("c > 1"), tasks)
    members = cut(prefixes.join(lists.where(F.col("c") > LIST_LIMIT).select("v", "leads"), "v").select("v", "id", "leads"), tasks)
    return _short_pairs(prefixes, lists, LIST_LIMIT).unionByName(_leader_pairs(members)), members.select("v", "id")


def _rest_links(members: DataFrame, links: DataFrame, held: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Components of `links`, and the links that members of long lists outside
    the largest component of their list have to anything hot."""
    comps = cut(connected_components(links, tasks=tasks), tasks)
    of = comps.select(F.col("node").alias("id"), "component")
    own = cut(members.join(of, "id", "left").select("v", "id", F.coalesce("component", "id").alias("comp")), tasks)
    largest = own.groupBy("v", "comp").agg(F.count("*").alias("c")).groupBy("v").agg(F.max(F.struct("c", "comp"))["comp"].alias("top"))
    asked = cut(own.join(largest, "v").where("comp != top").select("id").distinct(), tasks)
    edges = comps.select(F.col("node").alias("a"), F.col("component").alias("b"))
    sets = held.join(asked, "id", "left_semi").select("id", "full")
    # One block at a time: the query set grows with what the leaders left over.
    blocks = -(-int(sets.agg(F.coalesce(F.sum(F.size("full").cast("long") * 8 + 64), F.lit(0))).first()[0]) // QUERY_BYTES)
    rows = held.join(of, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "full")
    found = None
    for k in range(blocks):
        block = sets.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()
        sent = held.sparkSession.sparkContext.broadcast(([r["id"] for r in block], [np.array(r["full"], np.int64) for r in block]))
        new = cut(rows.mapInArrow(_against(sent), "a long, b long").distinct(), tasks)
        sent.unpersist()
        found = new if found is None else found.unionByName(new)
    return edges, found


def _against(sent):
    """(a, b): sent documents a whose full set reaches the similarity with that
    of a row, whose component is b. An index of the sent sets counts exactly."""

    def run(batches):
        ids, sets = sent.value
        names, sizes = np.array(ids, np.int64), np.array([len(x) for x in sets], np.int64)
        values = np.concatenate(sets)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(names)), sizes)[order]
        for batch in batches:
            links = set()
            flat, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for i, (doc, comp) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = flat[offsets[i] : offsets[i + 1]]
                low = np.searchsorted(values, own, "left")
                low = low[values[np.minimum(low, len(values) - 1)] == own]
                n = np.searchsorted(values, values[low], "right") - low
                if not len(n):
                    continue
                shared = np.bincount(owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(names))
                near = np.flatnonzero((100 * shared >= PERCENT * (sizes + len(own) - shared)) & (names != doc))
                links.update((int(names[j]), comp) for j in near)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of `docs`.

    Words are lower-cased A-Z runs of bytes other than white space; a set holds
    distinct 5-word shingles, or the whole sequence of a shorter text. Documents
    are linked when 100 * intersection >= 75 * union, component_id is the
    smallest doc_id reachable and kept marks that document. Shingles are
    compared by 64-bit hashes, in sketches and in full sets.

    Null or wordless text: an empty set, linked with nothing. Null doc_id: the
    row has component null and is kept. Repeated doc_id: one document with
    several texts, hence one component; each row is returned. Empty table: no
    rows. Very long texts are cut into words by blocks of bounded size. Other
    columns are ignored."""
    docs = batched(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = cut(docs.mapInArrow(_signatures(SKETCH), "id long, n long, f1 long, f2 long, sk array<long>"))
    tasks = tasks_for(sig.count())
    named = sig.where("n > 0 and id is not null")
    alike = cut(named.groupBy("f1", "f2").agg(F.min("id").alias("rep")), tasks)
    classes = named.join(alike.select(F.col("rep").alias("id"), "f1", "f2"), ["id", "f1", "f2"], "left_semi").dropDuplicates(["id", "f1", "f2"])
    classes = cut(classes.select("id", "n", "sk"), tasks)
    postings = classes.select("id", "n", F.explode(F.slice("sk", 1, POSTED)).alias("v"))

    lists = cut(postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), tasks)
    pairs = _short_pairs(postings, lists, LIST_LIMIT)
    in_long = postings.join(lists.where(F.col("c") > LIST_LIMIT).select("v"), "v").groupBy("id", "n").agg(F.count("*").alias("c"))
    m, p = F.least("n", F.lit(POSTED)), PERCENT / 100
    hot = cut(in_long.where(F.col("c") >= m * p - DEVIATIONS * F.sqrt(m * p * (1 - p))).select("id").distinct(), tasks)
    members, set_tasks = None, tasks_for(SET_ROWS * hot.count())
    if not hot.isEmpty():
        held = cut(_full(docs, hot).dropDuplicates(["id", "f1"]), set_tasks)
        more, members = _hot_pairs(held, tasks, set_tasks)
        pairs = pairs.unionByName(more)
    links = _confirmed(_estimated(pairs.distinct(), classes, SKETCH, PERCENT), docs, PERCENT, tasks)

    # A document with several texts belongs to the classes of all of them.
    doubled = named.groupBy("id").agg(F.min("f1").alias("x"), F.max("f1").alias("y"), F.min("f2").alias("z"), F.max("f2").alias("w")).where("x != y or z != w").select("id")
    bridges = named.join(doubled, "id", "left_semi").join(alike, ["f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a != b")
    links = links.unionByName(bridges)
    if members is not None:
        links, rest = _rest_links(members, links, held, tasks)
        links = links if rest is None else links.unionByName(rest)
    comps = connected_components(links, tasks=tasks)
    final = alike.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    final = cut(final, tasks)
    out = sig.join(final, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of which each group keeps one, with all their columns,
    whatever their names. Rows without an id stay; of several rows with one kept
    id, one stays. Null and empty texts stay. An empty table stays empty."""
    kept, rows = fresh(docs, "kept_id", "kept_rows")
    found = near_duplicates(docs, id_col, text_col).where("kept and doc_id is not null")
    found = cut(found.groupBy(F.col("doc_id").alias(kept)).agg(F.count("*").alias(rows)))
    pick = lambda where: docs.join(found.where(where).select(kept).hint("shuffle_hash"), F.col(id_col) == F.col(kept), "left_semi")
    once = pick(F.col(rows) == 1).unionByName(docs.where(F.col(id_col).isNull()))
    if found.where(F.col(rows) > 1).isEmpty():
        return once
    return once.unionByName(pick(F.col(rows) > 1).dropDuplicates([id_col]))

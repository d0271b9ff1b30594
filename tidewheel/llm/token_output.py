"""Token ids in a directly addressable binary format.

Ids are split into 8-bit chunks. Level 0 holds each id's lowest chunk, level 1
the next chunk of the ids that have one, and so on; a continuation bitmap per
level says which go on, and a rank directory (set bits before each 512) finds
an id's place on the next level. Any token is read with one rank query per
level, without decoding a block.

A segment is a self-contained byte string of whole documents. Segments are
rows of a Parquet table, so that they are written and committed by Spark on
any file system, survive lost executors, and are read back by any reader:
(part, seg, n_docs, n_tokens, payload).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import batched, scratch_path
from ._text import buffers, row_blocks
from ._tokens import END_ID, default_path, loaded

MAGIC = b"TDAC\x01"
HEAD = struct.Struct("<5sBIQQ")  # magic, levels, documents, tokens, tokens before it in its part
BLOCK = 2 << 20
SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512


def pack_levels(ids: np.ndarray) -> list[bytes]:
    """Chunk bytes, continuation bitmap and rank directory of each level."""
    out, rest = [], ids.astype(np.uint64)
    while len(out) == 0 or len(rest):
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint64)
        rank = np.concatenate(([0], np.cumsum(ones))).astype("<u8")
        out.append(struct.pack("<QQ", len(rest), len(bits)) + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        rest = rest[more] >> np.uint64(8)
    return out


def pack_segment(doc_ids: list, lens: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    """The bytes of a segment; doc_ids may hold None."""
    levels = pack_levels(ids)
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    return HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids), before) + known.tobytes() + numbers.tobytes() + lens.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """A packed segment, read in place."""

    def __init__(self, payload: bytes):
        magic, n_levels, n_docs, self.n_tokens, self.before = HEAD.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        view, at = np.frombuffer(payload, np.uint8), HEAD.size
        known = view[at : at + n_docs]
        at += n_docs
        numbers = view[at : at + 8 * n_docs].view("<i8") if n_docs else np.zeros(0, "<i8")
        self.doc_ids = [int(x) if k else None for k, x in zip(known, numbers, strict=True)]
        at += 8 * n_docs
        lens = view[at : at + 8 * n_docs].view("<u8").astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(lens)))
        at += 8 * n_docs
        self.levels = []
        for _ in range(n_levels):
            n, size = struct.unpack_from("<QQ", payload, at)
            at += 16
            chunks, bits = view[at : at + n], view[at + n : at + n + size]
            at += n + size
            n_rank = size // (RANK_BITS // 8) + 1
            self.levels.append((chunks, bits, np.frombuffer(payload, "<u8", n_rank, at)))
            at += 8 * n_rank

    def token(self, i: int) -> int:
        """Token i of the segment, by rank queries alone."""
        value, shift = 0, 0
        for chunks, bits, rank in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS
            low = block * RANK_BITS // 8
            before = int(np.bitwise_count(bits[low : i >> 3]).sum()) + int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            i, shift = int(rank[block]) + before, shift + 8
        raise ValueError("broken segment")

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out: np.ndarray | None = None
        for chunks, bits, _ in reversed(self.levels):
            level = chunks.astype(np.uint32)
            if out is not None:
                more = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
                level[more] |= out << np.uint32(8)
            out = level
        return out if out is not None else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(int(self.first[k]), int(self.first[k + 1]))], np.uint32)


def _writer(path: str, segment_tokens: int):
    def run(batches):
        spans, cache = loaded("ids", path)
        part, seg, before = TaskContext.get().partitionId(), 0, 0
        names, lens, parts, size = [], [], [], 0

        def flush():
            nonlocal seg, before, names, lens, parts, size
            payload = pack_segment(names, np.concatenate(lens), np.concatenate(parts), before)
            row = pa.RecordBatch.from_pydict({"part": [part], "seg": [seg], "n_docs": [len(names)], "n_tokens": [size], "payload": [payload]}, schema=SCHEMA_ARROW)
            seg, before = seg + 1, before + size
            names, lens, parts, size = [], [], [], 0
            return row

        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK):
                piece, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, hashes, first = spans(piece, offs)
                ids, span_lens = cache.flat(cache.rows(hashes, piece, starts, ends))
                sums = np.concatenate(([0], np.cumsum(span_lens)))
                ids = np.insert(ids, sums[first[1:]], END_ID)
                lens.append(sums[first[1:]] - sums[first[:-1]] + 1)
                names += batch.column(0).slice(lo, hi - lo).to_pylist()
                parts.append(ids)
                size += len(ids)
                if size >= segment_tokens:
                    yield flush()
        if names:
            yield flush()

    return run


SCHEMA = "part int, seg int, n_docs long, n_tokens long, payload binary"
SCHEMA_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, segment_tokens: int = SEGMENT_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), append the end id to each, and write
    segments under `path` in ascending doc_id order: ranges of ids are dealt to
    partitions, sorted there, and encoded as they stream by.

    Null ids come first, equal ids are ordered by a hash of their text. An empty
    table gives a folder without segments. A very long text is one document of
    one segment; other columns are ignored."""
    tokenizer = tokenizer or default_path("word_bpe_49k.json")
    rows = batched(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.mapInArrow(_writer(tokenizer, segment_tokens), SCHEMA).write.option("compression", "none").option("parquet.block.size", 16 << 20).parquet(path)


def _reader(batches):
    for batch in batches:
        for part, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            segment = Segment(payload.as_py())
            ids = segment.ids().astype("<u4")
            bounds = segment.first.tolist()
            crc = [zlib.crc32(ids[s:e].data) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array(segment.doc_ids, pa.int64()), pa.array(segment.first[:-1] + segment.before), pa.array(np.diff(segment.first)), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    A segment knows its place in its part; the places of the parts are prefix
    sums over one row per part, which their number of files bounds and which is
    all that is broadcast."""
    table = spark.read.schema(SCHEMA).parquet(path)
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    docs = table.select("part", "payload").mapInArrow(_reader, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    found = docs.join(F.broadcast(base), "part")
    return found.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the documents' tokens, then describe them as read from the files:
    (doc_id, start, n_tokens, ids_crc32) of every row, none for an empty table.
    Nulls, repeated rows and long texts are as write_tokens has them."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_tokens(docs, path)
    return read_tokens(spark, path)

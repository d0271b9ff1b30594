"""Token counts of documents by a public tokenizer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batched
from ._text import buffers, row_blocks
from ._tokens import default_path, loaded

BLOCK = 2 << 20
LIMIT = 4096


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, in one pass without
    a shuffle: Arrow functions encode blocks of about equal bytes and return
    lengths only. Long texts are cut at spaces no merge crosses, so a block's
    memory does not follow its longest text.

    `tokenizer`: path of a sentencepiece model on every machine (default: the
    installed public one). Null or empty text: 0 bytes, 0 tokens. Null ids and
    repeated rows: each row is counted. Other columns are ignored."""
    path = tokenizer or default_path("piece_bpe_32k.model")

    def run(batches):
        spans, cache = loaded("count", path)
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK):
                part, offs = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, ends, hashes, first = spans(part, offs)
                rows = cache.rows(hashes, part, starts, ends)
                sums = np.concatenate(([0], np.cumsum(cache.lens[rows], dtype=np.int64)))
                n = sums[first[1:]] - sums[first[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

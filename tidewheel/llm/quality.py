"""Quality rules with line sequence labelling.

Base rules count words, symbols, repeated lines and repeated word windows. For
the verdict, a linear-chain conditional random field labels each line of a text
as content or boilerplate (Viterbi decoding over both labels); a text is kept
if enough of its words stand in content lines.

The field is trained here: lines take the quality label of their document, then
the lines of low-quality documents that the field itself reads as content are
relabelled and it is trained once more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batched
from ._text import SHINGLE_WORDS, Words, buffers, grams, mix, row_blocks, span_hashes

BLOCK = 2 << 20
MIN_WORDS = 10
REPEAT_PERCENT = 20
CONTENT_SHARE = 0.5
#: Bounds of the fit, and nothing else: labelled documents, and the bytes of one.
MAX_TRAIN = 1500
MAX_TRAIN_BYTES = 200_000
PIECE = 64

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CLASSES = {
    "upper": np.array([65 <= b <= 90 for b in range(256)], np.int32),
    "letter": np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 0xC0 for b in range(256)], np.int32),
    "digit": np.array([48 <= b <= 57 for b in range(256)], np.int32),
    "symbol": _SYMBOL,
    "bang": np.array([b in b"!?" for b in range(256)], np.int32),
    "pipe": np.array([b in b"|" for b in range(256)], np.int32),
    "link": np.array([b in b"/@_=" for b in range(256)], np.int32),
}
N_FEATURES = 14


class Block:
    """Counts, lines and line features of some texts, all vectorised."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        words = Words(data, offsets, lower=False)
        first = words.first
        self.n_words = np.diff(first)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
        spans = points[words.ends] - points[words.starts]
        self.word_chars = per_text(spans, first)
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data], dtype=np.int64)))
        self.n_symbols = symbols[offsets[1:]] - symbols[offsets[:-1]]
        self.n_repeat_words = self._repeats(words, n)
        self._lines(data, offsets, words, n)

    @staticmethod
    def _repeats(words: Words, n: int) -> np.ndarray:
        first, total = words.first, len(words.starts)
        prints = grams(words.hashes, SHINGLE_WORDS)
        if not len(prints):
            return np.zeros(n, np.int64)
        doc = np.repeat(np.arange(n), np.diff(first))[: len(prints)]
        whole = np.flatnonzero(np.arange(len(prints)) + SHINGLE_WORDS <= first[doc + 1])
        keys = mix(prints[whole] ^ mix(doc[whole].astype(np.uint64), 7))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        again = whole[counts[inverse] > 1]
        cover = np.zeros(total + SHINGLE_WORDS + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + SHINGLE_WORDS, -1)
        return per_text((np.cumsum(cover)[:total] > 0).astype(np.int64), first)

    def _lines(self, data: np.ndarray, offsets: np.ndarray, words: Words, n: int) -> None:
        """Lines are cut at \\n; only those with a word count."""
        breaks = np.flatnonzero(data == 0x0A)
        full = np.flatnonzero(np.diff(offsets) > 0)
        starts = np.unique(np.concatenate([offsets[:-1][full], breaks[~np.isin(breaks + 1, offsets)] + 1]))
        starts = starts[starts < len(data)]
        ends = np.concatenate([starts[1:], [len(data)]]).astype(np.int64) if len(starts) else starts
        ends = np.where(np.isin(ends - 1, breaks), ends - 1, ends)
        w0, w1 = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
        some = w1 > w0
        starts, ends, w0, w1 = starts[some], ends[some], w0[some], w1[some]
        doc = np.searchsorted(offsets, starts, "right") - 1
        self.line_first = np.searchsorted(doc, np.arange(n + 1))
        self.line_words = w1 - w0
        hashes = span_hashes(data, starts, ends, False)
        keys = mix(hashes ^ mix(doc.astype(np.uint64), 9))
        _, first = np.unique(keys, return_index=True)
        again = np.ones(len(keys), np.int64)
        again[first] = 0
        self.n_dup_lines = per_text(again, self.line_first)
        size = np.maximum(ends - starts, 1).astype(np.float64)
        share = {}
        for name, table in _CLASSES.items():
            sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            share[name] = (sums[ends] - sums[starts]) / size
        last = data[np.maximum(words.ends[np.maximum(w1 - 1, 0)] - 1, 0)] if len(w1) else np.zeros(0, np.uint8)
        n_words = self.line_words.astype(np.float64)
        x = np.zeros((len(starts), N_FEATURES), np.float32)
        x[:, 0] = 1
        x[:, 1] = np.minimum(np.log1p(n_words), 5) / 3
        x[:, 2] = share["upper"] / np.maximum(share["letter"], 0.05) > 0.5
        x[:, 3] = share["symbol"] > 0.02
        x[:, 4] = np.minimum(share["symbol"] * 5, 1)
        x[:, 5] = share["bang"] > 0.02
        x[:, 6] = share["pipe"] > 0.01
        x[:, 7] = share["digit"] > 0.15
        x[:, 8] = share["link"] > 0.02
        x[:, 9] = last == 0x2E
        x[:, 10] = n_words < 4
        x[:, 11] = again
        x[:, 12] = share["letter"] < 0.6
        x[:, 13] = size / np.maximum(n_words, 1) > 14
        self.features = x


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


class LineField:
    """A linear-chain conditional random field with two labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # (features, 2), (2, 2)

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi labels (1: content) of the lines of many texts at once; texts
        are walked in step, the longest ones alone at the end."""
        scores = (features @ self.weights).astype(np.float64)
        labels = np.zeros(len(scores), np.int8)
        lens = np.diff(first)
        order = np.argsort(-lens, kind="stable")
        lens, at = lens[order], first[:-1][order]
        if not len(lens) or lens[0] == 0:
            return labels
        back = np.zeros((len(scores), 2), np.int8)
        live = int(np.searchsorted(-lens, 0, "left"))
        best = scores[at[:live]]
        ends = {}
        for t in range(1, int(lens[0]) + 1):
            now = int(np.searchsorted(-lens, -t, "left"))
            if now < live:
                ends[t] = best[now:live].argmax(1).astype(np.int8)
                best, live = best[:now], now
            if live:
                came = best[:, :, None] + self.moves[None]
                back[at[:live] + t] = came.argmax(1)
                best = came.max(1) + scores[at[:live] + t]
        state = np.zeros(len(lens), np.int8)
        for t in range(int(lens[0]), 0, -1):
            top = int(np.searchsorted(-lens, -t, "right"))
            if t in ends:
                low = int(np.searchsorted(-lens, -t, "left"))
                state[low:top] = ends[t]
            labels[at[:top] + t - 1] = state[:top]
            state[:top] = back[at[:top] + t - 1, state[:top]]
        return labels


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Maximise the conditional likelihood of label sequences by Adam steps on
    exact forward-backward gradients, over all sequences in step."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lens = np.array([len(sequences[i]) for i in order])
    width = int(lens[0])
    x = np.zeros((len(order), width, N_FEATURES), np.float32)
    y = np.zeros((len(order), width), np.int64)
    for row, i in enumerate(order):
        x[row, : lens[row]], y[row, : lens[row]] = sequences[i], labels[i]
    mask = np.arange(width)[None] < lens[:, None]
    gold = np.zeros((len(order), width, 2))
    gold[np.arange(len(order))[:, None], np.arange(width)[None], y] = 1
    gold *= mask[:, :, None]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    theta = np.zeros(N_FEATURES * 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    total = mask.sum()
    for step in range(1, rounds + 1):
        w, a = theta[: N_FEATURES * 2].reshape(N_FEATURES, 2), theta[N_FEATURES * 2 :].reshape(2, 2)
        s = x @ w
        fwd, bwd = np.zeros_like(s), np.zeros_like(s)
        fwd[:, 0] = s[:, 0]
        for t in range(1, width):
            n = int(mask[:, t].sum())
            fwd[:n, t] = s[:n, t] + np.logaddexp(fwd[:n, t - 1, :1] + a[0], fwd[:n, t - 1, 1:] + a[1])
        for t in range(width - 2, -1, -1):
            n = int(mask[:, t + 1].sum())
            nxt = s[:n, t + 1] + bwd[:n, t + 1]
            bwd[:n, t] = np.logaddexp(nxt[:, :1] + a[:, 0], nxt[:, 1:] + a[:, 1])
        z = np.logaddexp(*(fwd[:, 0] + bwd[:, 0]).T)
        post = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + a[None, None] + (s + bwd)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grad = np.concatenate([np.einsum("ntf,ntk->fk", x, gold - post).ravel(), (gold_moves - pair.sum((0, 1))).ravel()]) / total - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return LineField(theta[: N_FEATURES * 2].reshape(N_FEATURES, 2).copy(), theta[N_FEATURES * 2 :].reshape(2, 2).copy())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_train_bytes: int = MAX_TRAIN_BYTES) -> LineField | None:
    """Fit on at most `max_train` labelled documents, chosen by a hash of the id,
    each of at most `max_train_bytes`; None if labels are missing or all alike."""
    some = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    some = some.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = batched(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text") <= max_train_bytes)
    rows = rows.join(F.broadcast(some), "id").select("id", "label", "text")

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            block = Block(data, offsets)
            cut = block.line_first
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([block.features[cut[i] : cut[i + 1]].astype(np.float16).tobytes() for i in range(len(batch))], pa.binary())], names=["id", "label", "features"])

    got = sorted((r["id"], r["label"], bytes(r["features"])) for r in rows.mapInArrow(run, "id long, label int, features binary").collect())
    lines = [np.frombuffer(raw, np.float16).reshape(-1, N_FEATURES).astype(np.float32) for _, _, raw in got]
    marks = [label for _, label, _ in got]
    use = [i for i, x in enumerate(lines) if len(x)]
    if len({marks[i] for i in use}) < 2:
        return None
    # Long texts train in pieces of PIECE lines, which bounds the padded arrays.
    pieces = [(lines[i][at : at + PIECE], marks[i]) for i in use for at in range(0, len(lines[i]), PIECE)]
    lines, marks = [x for x, _ in pieces], [k for _, k in pieces]
    gold = [np.full(len(x), k, np.int64) for x, k in zip(lines, marks, strict=True)]
    field = fit(lines, gold)
    for i, k in enumerate(marks):
        if k == 0:
            read = field.decode(lines[i], np.array([0, len(lines[i])]))
            gold[i] = read.astype(np.int64) if not read.all() else gold[i]
    return fit(lines, gold)


def quality(docs: DataFrame, labels: DataFrame | None = None, field: LineField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share) of every row, over whole texts.

    base_failed: under 10 words, or over 20 % of words in repeated 5-word
    windows. kept: not base_failed and at least half of the words in content
    lines; without a field and without labels to train one the base rules
    decide alone. Null or empty text: no words, so base_failed. Null ids and
    repeated rows are judged each; other columns are ignored."""
    if field is None and labels is not None:
        field = train(docs, labels, id_col, text_col)

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            for lo, hi in row_blocks(offsets, BLOCK):
                b = Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                failed = (b.n_words < MIN_WORDS) | (100 * b.n_repeat_words > REPEAT_PERCENT * b.n_words)
                share = np.ones(hi - lo)
                if field is not None:
                    share = per_text(field.decode(b.features, b.line_first) * b.line_words, b.line_first) / np.maximum(b.n_words, 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in (b.n_words, b.word_chars, b.n_symbols, b.n_dup_lines, b.n_repeat_words)), pa.array(failed), pa.array(~failed & (share >= CONTENT_SHARE)), pa.array(share)],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"],
                )

    rows = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")

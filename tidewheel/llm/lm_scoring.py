"""Document scores by a gated recurrent language model with a class-factored
softmax, and by add-one word frequencies.

Tokens are words (A-Z lower-cased) and one end per document. Counts cover every
training document; word identity is a 64-bit hash whose low bits hold the word's
tail class (from its last two bytes).

The model gives log P(class | state) + log P(word | class, state). The most
frequent words form classes of about equal root mass with their own softmax;
every other word falls into its tail class, within which add-one frequencies
apply, so the whole vocabulary of any size has a proper probability.

It is trained in numpy by truncated backpropagation. Training documents are
dealt by hash into shards of about SHARD_TOKENS tokens, so how the files are cut
up does not matter; a shard is one task. In each of ROUNDS rounds a shard walks
its share of its documents in windows, carrying the state across windows and the
optimiser's moments across rounds, and parameters and moments are averaged over
the shards, one array each, by a tree. Every training document is walked once.
Scoring carries the state through the complete document.

The frequencies of the HEAD most frequent words go to every task; the others
are joined by hash. What is broadcast is bounded by HEAD and the model's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batched, cut, document_id_crc, drop
from ._text import Words, _LOWER, buffers, mix, row_blocks

HIDDEN = 12
VOCAB = 1024
CLASSES = 24
TAIL_CLASSES = 32
HEAD = 131_072
WINDOW = 24
SLOTS = 384
STRETCH = 16
TRAIN_STRETCH = 4
TRAIN_SLOTS = 192
SHARD_TOKENS = 6_000_000
ROUNDS = 4
FAN_IN = 8
LONG_LOG2 = 13
RATE = 0.02
BIAS_RATE = 0.05
DAMPING = 1e-4
BLOCK = 2 << 20
SEED = 7

_LOW = np.uint64(TAIL_CLASSES - 1)
END = (int(mix(np.array([12345], np.uint64))[0]) & ~(TAIL_CLASSES - 1)) - 2**63


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, tokens before each text); each text ends with END."""
    words = Words(data, offsets, lower=True)
    h = words.hashes
    if len(h):
        last = _LOWER[data[words.ends - 1]].astype(np.uint64)
        prior = np.where(words.ends - words.starts > 1, _LOWER[data[np.maximum(words.ends - 2, 0)]], 0).astype(np.uint64)
        h = (h & ~_LOW) | (mix(last * np.uint64(256) + prior, 31) & _LOW)
    n = np.diff(words.first)
    return np.insert(h.view(np.int64), words.first[1:], END), np.concatenate(([0], np.cumsum(n + 1)))


def _counts(batches):
    """Partial (hash, count) of a task's texts, combined as far as memory allows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def combined():
        keys = np.concatenate([k for k, _ in held])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[head], np.add.reduceat(np.concatenate([c for _, c in held])[order], head)

    def rows(k, c):
        for at in range(0, len(k), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(k[at : at + (1 << 17)]), pa.array(c[at : at + (1 << 17)])], names=["h", "c"])

    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for lo, hi in row_blocks(offsets, BLOCK):
            tokens, _ = token_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            held.append(np.unique(tokens, return_counts=True))
            if sum(len(k) for k, _ in held) > 1_500_000:
                held = [combined()]
                if len(held[0][0]) > 750_000:
                    yield from rows(*held[0])
                    held = []
    if held:
        yield from rows(*combined())


class Lexicon:
    """What every task knows of words: the head's frequencies and model rows.

    Vocabulary rows are ordered by class, rows VOCAB.. are tail classes, and the
    last row starts a document."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, vocab: int = VOCAB, classes: int = CLASSES):
        order = np.argsort(head, kind="stable")
        self.keys, self.counts = head[order], counts[order]
        top = np.lexsort((self.keys, -self.counts))[:vocab]
        mass = np.cumsum(np.sqrt(self.counts[top].astype(np.float64)))
        group = np.minimum((mass / mass[-1] * classes - 1e-9).astype(np.int64), classes - 1) if len(top) else np.zeros(0, np.int64)
        _, group = np.unique(group, return_inverse=True)  # no class without words
        self.n_vocab, self.n_classes = len(top), int(group.max()) + 1 if len(top) else 0
        self.row = np.full(len(self.keys), -1, np.int64)
        self.row[top] = np.arange(len(top))
        self.class_of = np.concatenate([group, self.n_classes + np.arange(TAIL_CLASSES)])
        self.class_first = np.searchsorted(group, np.arange(self.n_classes + 1))
        self.vocab_counts = self.counts[top]
        self.vocab_keys = self.keys[top]

    def rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model row, head frequency or -1) of each token."""
        row = self.n_vocab + (tokens.view(np.uint64) & _LOW).astype(np.int64)
        count = np.full(len(tokens), -1, np.int64)
        if len(self.keys):
            pos = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
            hit = self.keys[pos] == tokens
            count[hit] = self.counts[pos[hit]]
            own = np.where(hit, self.row[pos], -1)
            row = np.where(own >= 0, own, row)
        return row, count


class Gru:
    """Parameters of the model, as one flat float32 vector with views."""

    def __init__(self, lexicon: Lexicon, tail_counts: np.ndarray | None = None, flat: np.ndarray | None = None, hidden: int = HIDDEN):
        self.lex, self.hidden = lexicon, hidden
        n_in, n_class = lexicon.n_vocab + TAIL_CLASSES + 1, lexicon.n_classes + TAIL_CLASSES
        shapes = [("x", (n_in, 3 * hidden)), ("u", (hidden, 3 * hidden)), ("c", (n_class, hidden)), ("cb", (n_class,)), ("o", (lexicon.n_vocab, hidden)), ("ob", (lexicon.n_vocab,))]
        self.shapes, total = shapes, sum(int(np.prod(s)) for _, s in shapes)
        fresh = flat is None
        self.flat = np.zeros(total, np.float32) if fresh else flat.astype(np.float32)
        self.views(self.flat, self.__dict__)
        self.ones = np.ones(max(lexicon.n_vocab, n_class), np.float32)
        if fresh:
            rng = np.random.default_rng(SEED)
            self.x[:] = rng.normal(0, 0.1, self.x.shape)
            self.u[:] = rng.normal(0, 0.3, self.u.shape)
            self.c[:] = rng.normal(0, 0.05, self.c.shape)
            self.o[:] = rng.normal(0, 0.05, self.o.shape)
            self.ob[:] = np.log(lexicon.vocab_counts + 1.0)
            for lo, hi in zip(lexicon.class_first[:-1], lexicon.class_first[1:], strict=True):
                self.ob[lo:hi] -= self.ob[lo:hi].max()
            mass = np.bincount(lexicon.class_of[: lexicon.n_vocab], lexicon.vocab_counts, n_class) if lexicon.n_vocab else np.zeros(n_class)
            mass[lexicon.n_classes :] += tail_counts if tail_counts is not None else 0
            self.cb[:] = np.log((mass + 1) / (mass + 1).sum())

    def views(self, flat: np.ndarray, into: dict) -> None:
        at = 0
        for name, shape in self.shapes:
            size = int(np.prod(shape))
            into[name] = flat[at : at + size].reshape(shape)
            at += size

    def forward(self, rows_in: np.ndarray, h: np.ndarray):
        """States after each step of a window; rows_in is (steps, texts)."""
        k, kept, states = self.hidden, [], np.empty((*rows_in.shape, self.hidden), np.float32)
        gates = self.x[rows_in]
        for t in range(len(rows_in)):
            a = h @ self.u
            rz = gates[t, :, : 2 * k] + a[:, : 2 * k]
            rz *= 0.5
            np.tanh(rz, out=rz)
            rz += 1
            rz *= 0.5
            r, z = rz[:, :k], rz[:, k:]
            n = r * a[:, 2 * k :]
            n += gates[t, :, 2 * k :]
            np.tanh(n, out=n)
            kept.append((h, r, z, n, a[:, 2 * k :]))
            h = n + z * (h - n)
            states[t] = h
        return states, kept

    def outputs(self, before: np.ndarray, target: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each target given the state before it, and
        the gradient of their sum by that state."""
        lex = self.lex
        cls = lex.class_of[target]
        # States lie in (-1, 1) and weights are small, so logits need no shift.
        logits = before @ self.c.T
        logits += self.cb
        e = np.exp(logits)
        z = e @ self.ones[: e.shape[1]]
        at = np.arange(len(target))
        logp = logits[at, cls] - np.log(z)
        if grads is not None:
            d = e
            d *= (-1 / z)[:, None]
            d[at, cls] += 1
            grads["c"] += d.T @ before
            grads["cb"] += d.sum(0)
            dh = d @ self.c
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(lex.n_classes + 1))
        for k in range(lex.n_classes):
            some = order[bounds[k] : bounds[k + 1]]
            lo, hi = lex.class_first[k], lex.class_first[k + 1]
            if not len(some) or hi - lo < 2:
                continue
            s = before[some]
            logits = s @ self.o[lo:hi].T
            logits += self.ob[lo:hi]
            e = np.exp(logits)
            z = e @ self.ones[: hi - lo]
            mine = target[some] - lo
            logp[some] += logits[at[: len(some)], mine] - np.log(z)
            if grads is not None:
                d = e
                d *= (-1 / z)[:, None]
                d[at[: len(some)], mine] += 1
                grads["o"][lo:hi] += d.T @ s
                grads["ob"][lo:hi] += d.sum(0)
                dh[some] += d @ self.o[lo:hi]
        return (logp, dh) if grads is not None else (logp, None)

    def backward(self, rows_in: np.ndarray, kept: list, d_states: np.ndarray, grads: dict) -> None:
        """Truncated backpropagation through one window."""
        k = self.hidden
        d_in = np.empty((*rows_in.shape, 3 * k), np.float32)
        dh = np.zeros_like(d_states[0])
        ut = self.u.T.copy()
        for t in range(len(rows_in) - 1, -1, -1):
            h, r, z, n, an = kept[t]
            dh += d_states[t]
            one_z = 1 - z
            d_n = dh * one_z * (1 - n * n)
            d = d_in[t]
            np.multiply(d_n * an, r * (1 - r), out=d[:, :k])
            np.multiply(dh * (h - n), z * one_z, out=d[:, k : 2 * k])
            d[:, 2 * k :] = d_n
            d_a = d.copy()
            d_a[:, 2 * k :] *= r
            grads["u"] += h.T @ d_a
            dh *= z
            dh += d_a @ ut
        rows = rows_in.ravel()
        order = np.argsort(rows, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(rows[order]) != 0)))
        grads["x"][rows[order][head]] += np.add.reduceat(d_in.reshape(-1, 3 * k)[order], head, axis=0)


def _windows(texts, start_row: int, base: int, slots: int, stretch: int = 1):
    """Walk many texts side by side. Yields (inputs, targets with -1 past an end,
    slots that start a text, slots that end one, their keys) per window; a free
    slot takes the next text, so long texts run beside short ones. Where only a
    few long ones are left, windows are `stretch` times as long."""
    texts = iter(texts)
    live: list[list] = []  # [key, rows, place, fresh]
    more = True
    while True:
        while more and len(live) < slots:
            nxt = next(texts, None)
            if nxt is None:
                more = False
            else:
                live.append([nxt[0], nxt[1], 0, True])
        if not live:
            return
        window = base * stretch if not more and len(live) * stretch <= slots else base
        x = np.zeros((window, len(live)), np.int64)
        y = np.full((window, len(live)), -1, np.int64)
        for j, (_, rows, at, fresh) in enumerate(live):
            part = rows[at : at + window]
            n = len(part)
            y[:n, j] = part
            x[1:n, j] = part[: n - 1]
            x[0, j] = start_row if fresh else rows[at - 1]
        yield x, y, [s[3] for s in live], [s[0] for s in live]
        rest = []
        for j, s in enumerate(live):
            s[2] += window
            s[3] = False
            if s[2] < len(s[1]):
                rest.append((j, s))
        yield [j for j, _ in rest]
        live = [s for _, s in rest]


def _run(model: Gru, texts, on_window, window: int = WINDOW, slots: int = SLOTS, stretch: int = 1):
    """Drive windows with carried states; on_window gets (keys, x, y, states before
    each target, kept)."""
    walk = _windows(texts, model.lex.n_vocab + TAIL_CLASSES, window, slots, stretch)
    h = np.zeros((0, model.hidden), np.float32)
    for x, y, fresh, keys in walk:
        h = np.concatenate([h, np.zeros((len(fresh) - len(h), model.hidden), np.float32)])
        states, kept = model.forward(x, h)
        on_window(keys, x, y, states, kept)
        stay = next(walk)
        h = states[-1][stay]


def train_on(model: Gru, texts, moments: np.ndarray | None = None, rate: float = RATE) -> int:
    """Adam steps over all windows of all texts; returns the number of tokens.
    moments (2, parameters) are the optimiser's, which go on from call to call."""
    seen = 0
    speed, past = np.zeros((2, len(model.flat)), np.float32) if moments is None else moments
    # Biases start at log frequencies, which are right already without context.
    rates, parts = np.full_like(model.flat, rate), {}
    model.views(rates, parts)
    parts["cb"] *= BIAS_RATE
    parts["ob"] *= BIAS_RATE

    def step(keys, x, y, states, kept):
        nonlocal seen
        grads: dict = {}
        flat = np.zeros_like(model.flat)
        model.views(flat, grads)
        mask = y >= 0
        _, dh = model.outputs(states[mask], y[mask], grads)
        d_states = np.zeros_like(states)
        d_states[mask] = dh
        model.backward(x, kept, d_states, grads)
        n = int(mask.sum())
        flat /= max(n, 1, float(np.linalg.norm(flat)))  # mean gradient, of norm 1 at most
        seen += n
        full = n / (TRAIN_SLOTS * WINDOW)  # the last texts fill few slots: such windows count less
        speed[:] += 0.1 * full * (flat - speed)
        past[:] += 0.01 * full * (flat * flat - past)
        model.flat += full * rates * speed / (np.sqrt(past) + DAMPING)

    _run(model, texts, step, slots=TRAIN_SLOTS, stretch=TRAIN_STRETCH)
    return seen


def score_on(model: Gru, texts) -> dict:
    """Natural log-likelihood of each text under classes and vocabulary."""
    out: dict = {}

    def step(keys, x, y, states, kept):
        mask = y >= 0
        lp = np.zeros(y.shape, np.float64)
        lp[mask] = model.outputs(states[mask], y[mask])[0]
        for key, s in zip(keys, lp.sum(0).tolist(), strict=True):
            out[key] = out.get(key, 0.0) + s

    _run(model, texts, step, stretch=STRETCH)
    return out


def _texts(batches, lexicon: Lexicon, column: int):
    for batch in batches:
        data, offsets = buffers(batch.column(column))
        for lo, hi in row_blocks(offsets, BLOCK):
            tokens, first = token_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            row, count = lexicon.rows(tokens)
            yield batch, lo, hi, tokens, first, row, count


def _row(weight: int, arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([arrays.astype(np.float32).tobytes()], pa.binary())], names=["w", "v"])


def _mean(rows) -> tuple[int, np.ndarray | None]:
    """(sum of weights, weighted mean) of (weight, array bytes) rows."""
    weight, total = 0, None
    for w, v in rows:
        part = w * np.frombuffer(v, np.float32).astype(np.float64)
        weight, total = weight + w, part if total is None else total + part
    return weight, total / weight if weight else None


def _merged(batches):
    weight, mean = _mean((w, v) for batch in batches for w, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    if weight:
        yield _row(weight, mean)


def _round(docs: DataFrame, sent, arrays: np.ndarray, shards: int) -> np.ndarray:
    """Train each shard of `docs` from the same parameters and moments (arrays,
    in this order); their mean by tokens seen. Arrays of shards meet in tasks of
    FAN_IN rows, until so few are left that the driver takes them."""
    key = F.xxhash64("doc_id", "text")
    # Very long texts begin first, so that none of them is left to run alone.
    size = F.greatest(F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)), F.lit(LONG_LOG2))
    rows = docs.select("doc_id", "text").repartition(shards, key).sortWithinPartitions(size.desc(), key).select("text")
    start = docs.sparkSession.sparkContext.broadcast(arrays)

    def run(batches):
        lexicon, now = sent.value, start.value.copy()
        own = Gru(lexicon, flat=now[0])
        seen = train_on(own, ((0, row[first[i] : first[i + 1]]) for _, lo, hi, _, first, row, _ in _texts(batches, lexicon, 0) for i in range(hi - lo)), now[1:])
        if seen:
            yield _row(seen, np.concatenate([own.flat[None], now[1:]]))

    found = cut(rows.mapInArrow(run, "w long, v binary"))
    left, made = found.count(), [found]
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        made.append(cut(made[-1].repartition(left).mapInArrow(_merged, "w long, v binary")))
    mean = _mean((r["w"], r["v"]) for r in made[-1].collect())[1]
    drop(*made)
    start.unpersist()
    return arrays if mean is None else mean.astype(np.float32).reshape(arrays.shape)


@dataclass
class Fitted:
    """Counts of training tokens, and the model. Tail words are those outside the
    vocabulary: tail_n tokens and tail_v distinct ones in each tail class; counts
    (h, c) below 2 ** (least / 16) are not in the lexicon."""

    counts: DataFrame
    total: int
    distinct: int
    least: int
    lexicon: Lexicon
    tail_n: np.ndarray
    tail_v: np.ndarray
    model: Gru


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Fitted:
    """Count and train on the rows whose crc32(doc_id) mod 7 is not 2."""
    rows = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), document_id_crc(id_col).alias("crc"))
    training = rows.where("crc % 7 != 2").drop("crc")
    counts = cut(training.select("text").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))

    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    sizes = counts.groupBy(F.floor(F.log2("c") * 16).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()  # a thousand rows at most
    least, found = 10_000, 0
    for r in sizes:
        found += r["count"]
        if found > HEAD:
            break
        least = r["b"]
    head = counts.where(F.floor(F.log2("c") * 16).cast("int") >= least).toPandas()
    lexicon = Lexicon(head["h"].to_numpy(np.int64), head["c"].to_numpy(np.int64))
    in_class = {r["k"]: (r["c"], r["v"]) for r in counts.groupBy(F.pmod("h", F.lit(TAIL_CLASSES)).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    own = (lexicon.vocab_keys.view(np.uint64) & _LOW).astype(np.int64)
    tail_n = np.array([in_class.get(k, (0, 0))[0] for k in range(TAIL_CLASSES)], np.int64) - np.bincount(own, lexicon.vocab_counts, TAIL_CLASSES).astype(np.int64)
    tail_v = np.array([in_class.get(k, (0, 0))[1] for k in range(TAIL_CLASSES)], np.int64) - np.bincount(own, minlength=TAIL_CLASSES)

    model = Gru(lexicon, tail_counts=tail_n)
    if total:
        sent = docs.sparkSession.sparkContext.broadcast(lexicon)
        arrays = np.stack([model.flat, np.zeros_like(model.flat), np.zeros_like(model.flat)])
        part = F.pmod(F.xxhash64("text", "doc_id"), F.lit(ROUNDS))
        for k in range(ROUNDS):
            arrays = _round(training.where(part == k), sent, arrays, max(1, -(-total // SHARD_TOKENS)))
        model = Gru(lexicon, flat=arrays[0])
        sent.unpersist()
    return Fitted(counts, total, distinct, least, lexicon, tail_n, tail_v, model)


def score_documents(docs: DataFrame, fitted: Fitted | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of
    every row of `docs`.

    Rows with crc32(doc_id) mod 7 other than 2 train counts and model (a null
    id counts as 0). base_score: sum of log10((c + 1) / (N + V + 1)); score: the
    model's log10 probability. A null or empty text is its end token; a very long
    one runs window by window beside others. Repeated rows each train and each
    get a score. Without any training row every count is 0. Other columns are
    ignored."""
    fitted = fitted or fit(docs, id_col, text_col)
    rows = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), (document_id_crc(id_col) % 7 == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts, total, distinct, least = fitted.counts, fitted.total, fitted.distinct, fitted.least
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((fitted.lexicon, fitted.model.flat, -np.log10(fitted.tail_n + fitted.tail_v + 1.0)))

    def run(batches):
        lex, flat, in_tail = sent.value
        gru = Gru(lex, flat=flat)
        stamp = TaskContext.get().partitionId() << 40
        known: dict = {}
        number = 0

        def texts():
            nonlocal number
            for batch, lo, hi, tokens, first, row, count in _texts(batches, lex, 2):
                logs = np.concatenate(([0], np.cumsum(np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0), 0))))
                tail = row >= lex.n_vocab
                fixed = np.concatenate(([0], np.cumsum(np.where(tail, in_tail[np.maximum(row - lex.n_vocab, 0)], 0) + np.where(tail & (count >= 0), np.log10(np.maximum(count, 0) + 1.0), 0))))
                hits = np.concatenate(([0], np.cumsum(count >= 0)))
                ids, held = batch.column(0).slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist()
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    rare, times = np.unique(tokens[a:b][count[a:b] < 0], return_counts=True)
                    known[number] = (stamp + number, ids[i], held[i], b - a, hits[b] - hits[a], logs[b] - logs[a], fixed[b] - fixed[a], rare, times)
                    yield number, row[a:b]
                    number += 1

        done: dict = {}

        def rows_out(keys):
            got = [known.pop(k) for k in keys]
            lens = np.concatenate(([0], np.cumsum([len(g[7]) for g in got]))).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [*(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()))), pa.array([g[6] + done.pop(k) / np.log(10) for k, g in zip(keys, got, strict=True)], pa.float64()),
                 pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([g[7] for g in got]), pa.int64())), pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate([g[8] for g in got]).astype(np.int32)))],
                names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "logs", "model", "rare", "times"],
            )

        walk = _windows(texts(), lex.n_vocab + TAIL_CLASSES, WINDOW, SLOTS, STRETCH)
        h = np.zeros((0, gru.hidden), np.float32)
        ended: list = []
        for x, y, fresh, keys in walk:
            h = np.concatenate([h, np.zeros((len(fresh) - len(h), gru.hidden), np.float32)])
            before, _ = gru.forward(x, h)
            mask = y >= 0
            lp = np.zeros(y.shape, np.float64)
            lp[mask] = gru.outputs(before[mask], y[mask])[0]
            for key, s in zip(keys, lp.sum(0).tolist(), strict=True):
                done[key] = done.get(key, 0.0) + s
            stay = next(walk)
            h = before[-1][stay]
            left = set(stay)
            ended += [k for j, k in enumerate(keys) if j not in left]
            if len(ended) >= 512:
                yield rows_out(ended)
                ended = []
        if ended:
            yield rows_out(ended)

    scored = cut(rows.mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double, rare array<long>, times array<int>"))
    words = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("m"))
    tail = counts.where(F.floor(F.log2("c") * 16).cast("int") < least)
    met = words.join(tail, "h").groupBy("rid").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs"))
    out = scored.drop("rare", "times").join(met, "rid", "left")
    known, logs = F.coalesce("more", F.lit(0)), F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + logs - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )

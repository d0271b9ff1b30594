"""Language identification by nearest centroids.

A document is a TF-IDF vector over hashed character 1- to 3-grams of its
lower-cased letters (other characters act as one space), scaled to length one.
Each language has several centroids (spherical k-means over its training
vectors); the language of the centroid with the largest cosine wins. A text
much farther from its centroid than training texts of like length (see REJECT),
mostly of letters of scripts that its language does not use, or of far fewer
letters among its characters than training texts, is rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import batched, document_id_crc
from ._text import buffers, row_blocks

BINS = 4096
CENTROIDS = 4
#: Bounds of the fit, and nothing else: training rows in all, languages.
MAX_TRAIN = 2000
MAX_LANGS = 500
UNKNOWN = "und"
#: A text is rejected below this share of a low quantile of the cosines that
#: training texts of its language have to their centroids: those of its length
#: class and of the nearest ones, as far as it takes for LIKE texts. A language
#: of fewer training texts has a floor lower in proportion.
REJECT, LOW, LIKE = 0.6, 0.02, 20
#: Scripts are told by blocks of 128 code points. A language uses those that a
#: hundredth of its training texts have; a text with less than this share of its
#: letters in them is rejected, and so is one whose letters in them are a smaller
#: part of its characters than REJECT of the LOW quantile of training texts, or
#: than LETTERS where that is less.
SCRIPT, LETTERS, SCRIPTS = 0.5, 0.25, 0x110000 >> 7
BLOCK = 1 << 20

_TABLES: dict[str, np.ndarray] = {}


def _table(kind: str) -> np.ndarray:
    """Whether str.<kind> holds for each code point."""
    if kind not in _TABLES:
        _TABLES[kind] = np.fromiter((getattr(chr(i), kind)() for i in range(0x110000)), bool, 0x110000)
    return _TABLES[kind]


def gram_counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _table("isalpha")[codes]
    if not letter.any():
        return None
    codes = np.concatenate((np.zeros(1, np.uint32), np.where(letter, codes, 0).astype(np.uint32), np.zeros(1, np.uint32)))
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    keep[0] = True
    codes = codes[keep]
    out = np.zeros(BINS, np.int64)
    h = codes * np.uint32(0x9E3779B1)
    for n in range(1, 4):
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[n - 1 :] * np.uint32(0x9E3779B1)
        if len(h):
            out += np.bincount((h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(20), minlength=BINS)
    return out


def scripts(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """The blocks of a text's letters, how many letters are in each, and how many
    characters the text has beside white space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    found = np.bincount(codes[_table("isalpha")[codes]] >> np.uint32(7))
    blocks = np.flatnonzero(found)
    return blocks, found[blocks], int(len(codes) - _table("isspace")[codes].sum())


class Model:
    """idf, unit centroids with their language, the cosine each language and
    length class must reach, the script blocks each language uses, and the share
    of a text's characters that letters in them must have."""

    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floors: np.ndarray, known: np.ndarray, shares: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.floors, self.known, self.shares = langs, idf, centroids, owner, floors, known, shares

    def foreign(self, lang: int, blocks: np.ndarray, letters: np.ndarray, solid: int) -> bool:
        """Whether too few letters, or too few characters, are letters of scripts
        that a language uses."""
        own = letters[self.known[lang, blocks]].sum()
        return bool(own < SCRIPT * letters.sum() or own < self.shares[lang] * solid)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts.astype(np.float32)) * self.idf)

    def best(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine, rejected) for each row of counts."""
        cosines = self.vectors(counts) @ self.centroids.T
        which = cosines.argmax(1)
        score, lang = cosines[np.arange(len(which)), which], self.owner[which]
        return lang, np.clip(score, 0, 1), score < self.floors[lang, length_class(counts)]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(1) + 1).astype(np.int64), 39)


def _apart(own: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The cosine of each training vector to the nearest centroid of its language,
    as if its own centroid had been fitted without it; 0 for a single vector."""
    cosines, rows = own @ centers.T, np.arange(len(own))
    near = cosines.argmax(1)
    sums = np.stack([own[near == i].sum(0) for i in range(len(centers))])
    with_sum = (own * sums[near]).sum(1)
    rest = np.sqrt(np.maximum((sums[near] ** 2).sum(1) - 2 * with_sum + 1, 0))
    alone = np.bincount(near, minlength=len(centers))[near] == 1
    cosines[rows, near] = np.where(alone, 0, (with_sum - 1) / np.maximum(rest, 1e-6))
    return np.clip(cosines.max(1), 0, 1)


def fit(langs: list[str], labels: np.ndarray, counts: np.ndarray, blocks: list[np.ndarray], letters: np.ndarray, centroids: int = CENTROIDS, rounds: int = 12) -> Model:
    """Fit from training counts, the script blocks of each training text and the
    letters' part of its characters; labels index langs."""
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = unit(np.log1p(counts.astype(np.float32)) * idf)
    centers, owner = [], []
    for k in range(len(langs)):
        own = x[labels == k]
        if not len(own):
            continue
        picks = [int((own @ own.mean(0)).argmax())]
        while len(picks) < min(centroids, len(own)):  # farthest first
            picks.append(int((own @ own[picks].T).max(1).argmin()))
        c = own[picks]
        for _ in range(rounds):
            near = (own @ c.T).argmax(1)
            c = unit(np.stack([own[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))]))
        centers.append(c)
        owner += [k] * len(c)
    c, owner = np.concatenate(centers), np.array(owner)
    floors, classes = np.zeros((len(langs), 40), np.float32), length_class(counts)
    shares = np.zeros(len(langs))
    for k in range(len(langs)):
        if not (labels == k).any():
            continue
        shares[k] = min(LETTERS, REJECT * np.quantile(letters[labels == k], LOW))
        own = _apart(x[labels == k], c[owner == k])
        for size in range(floors.shape[1]):
            away = abs(classes[labels == k] - size)
            like = own[away <= np.sort(away)[min(LIKE, len(own)) - 1]]
            floors[k, size] = REJECT * np.quantile(like, LOW) * min(1, len(own) / LIKE)
    known = np.zeros((len(langs), SCRIPTS), np.int64)
    for k, x in zip(labels, blocks, strict=True):
        known[k, x] += 1
    known = known >= np.maximum(1, np.bincount(labels, minlength=len(langs)) / 100)[:, None]
    return Model(langs, idf, c.astype(np.float32), owner, floors, known, shares)


def _sample_counts(batches):
    """One row for each sampled key of a task: equal rows share a key."""
    seen = set()
    for batch in batches:
        for key, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (key, lang) in seen:
                continue
            seen.add((key, lang))
            text = text.as_py()
            counts = gram_counts(text)
            if counts is not None:
                blocks, letters, solid = scripts(text)
                row = [key], [lang], [np.minimum(counts, 65535).astype(np.uint16).tobytes()], [blocks.astype(np.uint16).tobytes()], [letters.sum() / solid]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64()), strict=True)], names=["key", "lang", "counts", "blocks", "letters"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, max_langs: int = MAX_LANGS) -> Model | None:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 4 is
    not 2, spread evenly over languages and chosen by a hash of id and text;
    equal rows count once. max_train bounds the rows, max_langs the languages
    (the most frequent ones). None if there is no such row with a letter."""
    rows = batched(docs).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), document_id_crc(id_col).alias("crc"))
    rows = rows.where("crc % 4 != 2 and lang is not null and text is not null")
    langs = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()
    if not langs:
        return None
    share = max(1, max_train // len(langs))
    chosen = F.create_map(*[x for r in langs for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.3 * (share + 4) / r["count"])))])
    key = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    sample = rows.withColumn("key", key).where(F.col("key") < chosen[F.col("lang")] * float(1 << 30)).select("key", "lang", "text")
    # A task gives each key once, so equal rows cannot pile up in the shuffle or here.
    sample = sample.mapInArrow(_sample_counts, "key long, lang string, counts binary, blocks binary, letters double").dropDuplicates(["lang", "key"])
    got = sorted(((r["lang"], r["key"], bytes(r["counts"]), bytes(r["blocks"]), r["letters"]) for r in sample.collect()))
    names = sorted({x[0] for x in got})
    taken = {x: 0 for x in names}
    labels, counts, blocks, letters = [], [], [], []
    for lang, _, raw, used, part in got:
        if taken[lang] < share:
            taken[lang] += 1
            labels.append(names.index(lang))
            counts.append(np.frombuffer(raw, np.uint16))
            blocks.append(np.frombuffer(used, np.uint16))
            letters.append(part)
    return fit(names, np.array(labels), np.stack(counts), blocks, np.array(letters)) if labels else None


def _judged(column, model: Model | None):
    """(lang or None, score, rejected) of each text of a column."""
    data, offsets = buffers(column)
    raw = data.tobytes()
    lang, score, rejected = [], [], []
    for lo, hi in row_blocks(offsets, BLOCK):
        texts = [raw[offsets[i] : offsets[i + 1]].decode() for i in range(lo, hi)]
        found = [gram_counts(x) for x in texts]
        rows = [i for i, x in enumerate(found) if x is not None]
        langs, scores, bad = [UNKNOWN] * (hi - lo), np.zeros(hi - lo), np.ones(hi - lo, bool)
        if rows and model is not None:
            for at in range(0, len(rows), 256):
                some = rows[at : at + 256]
                k, s, r = model.best(np.stack([found[i] for i in some]))
                scores[some], bad[some] = s, r
                for i, x in zip(some, k.tolist(), strict=True):
                    langs[i] = model.langs[x]
                    bad[i] = bad[i] or model.foreign(x, *scripts(texts[i]))
        lang += langs
        score.append(scores)
        rejected.append(bad)
    return lang, np.concatenate(score) if score else np.zeros(0), np.concatenate(rejected) if rejected else np.zeros(0, bool)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row of `docs`.

    held_out: crc32(doc_id) mod 4 is 2; those rows never train. Predictions use
    the whole text and nothing else. A text that is null or has no letter is
    `und` with score 0, and so is every text if nothing could be learned.
    rejected: `und`, too far from every centroid or of other scripts; lang_pred then still names
    the nearest. A null id counts as crc 0; repeated rows are each judged."""
    model = model or train(docs, id_col, text_col, lang_col)

    def run(batches):
        for batch in batches:
            lang, score, rejected = _judged(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = batched(docs).select(F.col(id_col).cast("long").alias("doc_id"), (document_id_crc(id_col) % 4 == 2).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is not rejected.
    Null, empty and letterless texts go, and so does every row if nothing could be
    learned; null and repeated ids are judged row by row; an empty table stays
    empty. Very long texts are judged whole."""
    model = train(docs, id_col, text_col, lang_col)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_judged(batch.column(at), model)[2]))

    return docs.mapInArrow(run, docs.schema)

"""Tokenising by independent spans, with a bounded per-process cache.

A text is cut only where its tokenizer cannot join across, so that the tokens of
the text are those of its spans in order. Distinct spans of a block are encoded
once; spans seen before come from a sorted array of 64-bit span hashes.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np

from ._text import Words, _LOWER, span_hashes

END_ID = 1
#: What a process keeps of spans encoded before.
CACHE_BYTES = 24 << 20


class SpanCache:
    """Token ids (or only their number) of byte spans, by span hash.

    Holds about `limit` bytes; when it overflows, only the spans of the block
    at hand stay. Results never depend on what the cache holds."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = CACHE_BYTES):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.lens = np.zeros(0, np.int32)
        self.at = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def rows(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each span its row in lens and at."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.keys.nbytes + self.lens.nbytes + self.at.nbytes + self.pool.nbytes > self.limit:
            self._clear()
        pos = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = pos < len(self.keys)
        known[inside] = self.keys[pos[inside]] == distinct[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            lens, ids = self.encode([raw[s:e].decode() for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), 2 * len(ids)), np.uint32)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(lens) - lens if len(ids) else np.zeros(len(new), np.int64)
            self.lens = np.insert(self.lens, pos[new], lens.astype(np.int32))
            self.at = np.insert(self.at, pos[new], at)
            self.keys = np.insert(self.keys, pos[new], distinct[new])
            self.used += len(ids)
            pos = np.searchsorted(self.keys, distinct)
        return pos[inverse]

    def flat(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in order, tokens of each span)."""
        lens = self.lens[rows].astype(np.int64)
        ends = np.cumsum(lens)
        index = np.repeat(self.at[rows] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[index], lens


# --- the tokenizers library ---------------------------------------------------

# The settings under which word_spans cuts where nothing joins.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,!?;:#$%&*()")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_SEPARATOR = "<|endoftext|>"


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, spans before each text): words, cut also between a
    letter (ASCII or Latin-1) and one of a few ASCII marks. The pre-tokenizer
    splits there as well, no canonical composition reaches across, and the
    special strings hold neither white space nor such a pair. Case of A-Z does
    not matter to the tokenizer but within special strings; spans with `<|`
    keep it."""
    words = Words(data, offsets, lower=False)
    n = len(data)
    letter_end = _ALPHA[data]
    letter_start = letter_end.copy()
    if n > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        letter_end[1:] |= latin
        letter_start[:-1] |= latin
    mark = _PUNCT[data]
    cut = np.flatnonzero((letter_end[:-1] & mark[1:]) | (mark[:-1] & letter_start[1:])) + 1 if n > 1 else np.zeros(0, np.int64)
    where = np.searchsorted(words.starts, cut, "right") - 1
    inside = (where >= 0) & (cut > words.starts[np.maximum(where, 0)]) & (cut < words.ends[np.maximum(where, 0)]) if len(words.starts) else np.zeros(len(cut), bool)
    cut = cut[inside]
    starts = np.sort(np.concatenate([words.starts, cut]))
    ends = np.sort(np.concatenate([words.ends, cut]))
    lowered = _LOWER[data]
    if n > 1:
        for p in np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)):
            k = int(np.searchsorted(starts, p, "right")) - 1
            lowered[starts[k] : ends[k]] = data[starts[k] : ends[k]]
    return starts, ends, span_hashes(lowered, starts, ends, False), np.searchsorted(starts, offsets)


def json_tokenizer(path: str) -> tuple[Callable, Callable]:
    """(spans function, encoder) of a tokenizers file. Texts are cut into words
    only under the settings that word_spans knows; any other file gets whole
    texts, one by one."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec.get("added_tokens") or []]
    cuttable = (
        spec.get("normalizer") == WORD_NORMALIZER and spec.get("pre_tokenizer") == WORD_SPLIT and not spec.get("post_processor") and not spec.get("truncation") and not spec.get("padding")
        and all(x.startswith("<|") and x.endswith("|>") and x[2:-2].isalpha() for x in specials)
    )

    def whole(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens, parts = [], [np.zeros(0, np.uint32)]
        for text in texts:
            parts.append(np.array(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
            lens.append(len(parts[-1]))
        return np.array(lens, np.int64), np.concatenate(parts)

    return (word_spans, _joining(tok)) if cuttable else (whole_spans, whole)


def _joining(tok) -> Callable:
    """Encode many words in one call each: a special token stands between them,
    which the library splits off first. Spans that hold `<|` go one by one."""
    separator = tok.token_to_id(_SEPARATOR)

    def encode(spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens, parts, at = [], [], 0
        while at < len(spans):
            to, size = at, 0
            plain = "<|" not in spans[at]
            while to < len(spans) and size < 1 << 18 and to - at < 8192 and plain and "<|" not in spans[to]:
                size += len(spans[to])
                to += 1
            if separator is None or not plain:
                to = at + 1
                ids = np.array(tok.encode_batch_fast([spans[at]], add_special_tokens=False)[0].ids, np.uint32)
                lens.append(np.array([len(ids)]))
            else:
                ids = np.array(tok.encode_batch_fast([_SEPARATOR.join(spans[at:to])], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.concatenate(([-1], np.flatnonzero(ids == separator), [len(ids)]))
                lens.append(np.diff(cuts) - 1)
                ids = ids[ids != separator]
            parts.append(ids)
            at = to
        return np.concatenate(lens).astype(np.int64), np.concatenate(parts)

    return encode


# --- sentencepiece ----------------------------------------------------------


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, spans before each text): texts cut at each single
    space between two other characters. The next span leaves that space out:
    the marker the library puts before it takes its place."""
    n = len(data)
    space = data == 0x20
    if n > 2:  # U+2581 is the library's own space mark
        mark = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        space_like = space.copy()
        space_like[:-2] |= mark
        space_like[2:] |= mark
    else:
        space_like = space
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    at = np.flatnonzero(space[1:-1] & ~space_like[:-2] & ~space_like[2:] & ~edge[1 : n - 1] & ~edge[2:n]) + 1 if n > 2 else np.zeros(0, np.int64)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.concatenate([offsets[:-1][full], at + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], at]))
    return starts, ends, span_hashes(data, starts, ends, False), np.searchsorted(starts, offsets)


def whole_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One span for each text that has a byte: for models that cannot be cut."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts, ends = offsets[:-1][full], offsets[1:][full]
    return starts, ends, span_hashes(data, starts, ends, False), np.searchsorted(starts, offsets)


def piece_model(path: str) -> tuple[Callable, Callable]:
    """(spans function, lengths-only encoder) of a sentencepiece model. Texts are
    cut only if the model merges nothing across a space: BPE, an identity
    normaliser with a marker before the text, and no piece with a space mark
    after another character."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm, train = spec.normalizer_spec, spec.trainer_spec
    cuttable = (
        train.model_type == 2 and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not train.treat_whitespace_as_suffix
        and not any("▁" in p.piece.lstrip("▁") for p in spec.pieces) and not any(p.type == 4 for p in spec.pieces)
    )

    def encode(spans: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens, at = [], 0
        while at < len(spans):
            to, size = at, 0
            while to < len(spans) and (to == at or size + len(spans[to]) < 1 << 18):
                size += len(spans[to])
                to += 1
            lens += [len(x) for x in sp.encode(spans[at:to], num_threads=1)]
            at = to
        return np.array(lens, np.int64), np.zeros(0, np.uint32)

    return (piece_spans if cuttable else whole_spans), encode


_LOADED: dict[tuple[str, str], tuple] = {}


def loaded(kind: str, path: str) -> tuple[Callable, SpanCache]:
    """(spans function, cache) of this process for a tokenizer file."""
    if (kind, path) not in _LOADED:
        if path.endswith(".model"):
            spans, encode = piece_model(path)
        else:
            spans, encode = json_tokenizer(path)
        _LOADED[kind, path] = spans, SpanCache(encode)
    return _LOADED[kind, path]


def default_path(name: str) -> str:
    """Where the installed public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path(name)

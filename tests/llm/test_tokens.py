import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidewheel.llm import _text, _tokens, token_counts, token_output

WORD, PIECE = _tokens.default_path("word_bpe_49k.json"), _tokens.default_path("piece_bpe_32k.model")
ODD = [
    "", " ", "a", "  lead", "trail  ", "a  b c", "x\ty\n\nz \n w", "<|endoftext|>", "hi<|endoftext|>there <|ENDOFTEXT|> <|EndofText|>a.b", "<|startoftext|> a<|b.c", "don't, can't. it's!x .'s ,'t", "é,à.b ×.a a×.b ÷", "AΣ.b ΑΣ, Σ.",
    "▁ a ▁b c▁ d▁▁ e", "日本語。text,日本", "1.5,a1.b2", "a\x00b c", "word" * 3000, "a.b,c;d(e)f*g&h%i$j#k:l?m!n", "ﬁx. K.K", "x ́y .́a a.́b", "tab\x0bvt\x0cff\x1cfs\x85nel", "</s> <s> [INST] <unk>", "İstanbul, ǅ.a",
]


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=PIECE)


def ids_of(text, word):
    return word.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [_tokens.CACHE_BYTES, 10])
def test_spans_equal_whole_texts(word, limit):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("aBé .,\n\t'<|>1×日́Σ▁") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    spans, cache = _tokens.loaded("ids", WORD)
    cache.limit = limit
    for at in range(0, len(texts), 97):
        some = texts[at : at + 97]
        data, offsets = _text.buffers(pa.array(some))
        starts, ends, hashes, first = spans(data, offsets)
        ids, lens = cache.flat(cache.rows(hashes, data, starts, ends))
        sums = np.concatenate(([0], np.cumsum(lens)))
        for i, t in enumerate(some):
            assert ids[sums[first[i]] : sums[first[i + 1]]].tolist() == ids_of(t, word), t


def test_other_tokenizer_files_get_whole_texts(spark, docs, tmp_path):
    """The byte-level vocabulary, which keeps case and white space."""
    path = _tokens.default_path("byte_bpe_50k.json")
    token_output.write_tokens(docs, str(tmp_path / "out"), tokenizer=path)
    plain = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_output.read_tokens(spark, str(tmp_path / "out")).collect()}
    for r in docs.collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_counts_equal_whole_texts(spark, docs, piece):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("aBé .,\n\t▁日") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = token_counts.token_counts(frame).collect()
    want = {(r["doc_id"], len((r["text"] or "").encode()), len(piece.encode(r["text"] or ""))) for r in frame.collect()}
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got} == want and len(got) == frame.count()
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


def test_counts_of_nothing(empty, clashing):
    assert token_counts.token_counts(empty).count() == 0
    assert token_counts.token_counts(clashing).count() == clashing.count()


def test_segments_are_addressable():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 60_000, 3000).astype(np.uint32)
    ids[:8] = [0, 255, 256, 65_535, 65_536, 2**24, 2**32 - 1, 1]
    segment = token_output.Segment(token_output.pack_segment([4, None, -7], np.array([1000, 0, 2000]), ids, 99))
    assert (segment.ids() == ids).all() and segment.doc_ids == [4, None, -7] and segment.before == 99
    assert [segment.token(i) for i in range(3000)] == ids.tolist()
    assert (segment.document(2)[:50] == ids[1000:1050]).all() and len(segment.document(1)) == 0
    nothing = token_output.Segment(token_output.pack_segment([], np.zeros(0, np.int64), np.zeros(0, np.uint32), 0))
    assert len(nothing.ids()) == 0
    with pytest.raises(ValueError):
        token_output.Segment(b"x" * 40)


@pytest.mark.parametrize("size", [1 << 20, 300])
def test_files_hold_all_documents_in_order(spark, docs, word, tmp_path, size):
    path = str(tmp_path / "tokens")
    token_output.write_tokens(docs, path, segment_tokens=size)
    got = token_output.read_tokens(spark, path).collect()
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    at, want = 0, []
    for r in rows:
        ids = np.array([*ids_of(r["text"], word), 1], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=lambda r: r[1]) == want


def test_files_of_nothing(empty, clashing):
    assert token_output.token_files(empty).count() == 0
    got = token_output.token_files(clashing).collect()
    assert len(got) == clashing.count() and len({r["start"] for r in got}) == len(got)

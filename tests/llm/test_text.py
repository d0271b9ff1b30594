import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import _text
from tidewheel.llm._native import first_words, word_count

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x0c\r.\x1c\x85日", max_size=30) | st.none(), max_size=8))
def test_words_of_any_texts(texts):
    data, offsets = _text.buffers(pa.array(texts, pa.string()))
    words = _text.Words(data, offsets, lower=True)
    mine = [[bytes(data[s:e]) for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert mine == [(t or "").encode().split() for t in texts]
    names = {}
    for w, h in zip([x for own in mine for x in own], words.hashes.tolist(), strict=True):
        assert names.setdefault(w.translate(LOWER), h) == h
    assert len(set(names.values())) == len(names)


def test_blocks_do_not_matter(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    whole = _text.Words(*_text.buffers(pa.array(texts)), lower=False)
    monkeypatch.setattr(_text, "BLOCK_BYTES", 37)
    parts = _text.Words(*_text.buffers(pa.array(texts)), lower=False)
    assert (whole.starts == parts.starts).all() and (whole.ends == parts.ends).all() and (whole.hashes == parts.hashes).all()


def test_shingle_sets():
    words = _text.Words(*_text.buffers(pa.array(["a b c d e f a b c d e f", "a b", "b a", "a b x", ""])), lower=False)
    own = [words.hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    assert [len(_text.shingle_set(x)) for x in own] == [6, 1, 1, 1, 0]
    assert len({int(_text.shingle_set(x)[0]) for x in own[1:4]}) == 3
    assert len(np.unique(_text.grams(own[0]))) == 6


def test_native_word_count(spark):
    texts = ["", " ", "a", " a ", "a b\tc\n\x0bd\x0ce\rf", "  x  y  ", None, "é à\x1cb", "\n", "日本 語"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", word_count(F.col("t"))).collect()}
    assert got == {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]) for i, t in enumerate(texts)}
    cut = spark.createDataFrame([("  one\t two\nthree ", 2)], "t string, n int").select(first_words(F.col("t"), F.col("n"))).first()[0]
    assert cut == "  one\t two"

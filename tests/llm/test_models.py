"""Language ID, decontamination, quality rules and language-model scores."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest_data import LOWER, plain_words
from pyspark.sql import functions as F

from tidewheel.llm import _text, decontaminate, language, lm_scoring, quality


# --- language ----------------------------------------------------------------


def test_language_held_out_accuracy(docs):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    rows = {r["doc_id"]: r for r in docs.collect()}
    held = [i for i in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in rows if i is not None)
    long = [i for i in held if i < 1000 and len(rows[i]["text"]) > 60]
    assert sum(got[i]["lang_pred"] == rows[i]["lang"] for i in long) >= 0.95 * len(long)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i in (1000, 1001, 1002, 1006, 1010):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
    assert all(got[i]["lang_pred"] in ("en", "fr", "de") for i in rows if i is not None and i not in (1000, 1001, 1002, 1006, 1010))
    assert not any(got[i]["rejected"] for i in rows if i is not None and i < 1000)


def test_language_ignores_labels_of_what_it_predicts(spark, docs):
    some = language.train(docs)
    swapped = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    one = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs, some).collect()}
    two = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(swapped).collect()}
    assert one == two


def test_language_rejects_the_distant(spark, docs):
    model = language.train(docs.where("doc_id < 1000"))
    odd = spark.createDataFrame([(1, "ここ に ある 文字 は どれ も 学ん で いない もの です " * 20), (2, "the of and to in that is was he for it with as his on")], "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in language.identify(odd, model).collect()}
    assert got == {1: True, 2: False}


def test_language_rejects_foreign_texts_of_all_lengths(spark, docs):
    """Other scripts, and a made-up language in Latin letters, from 2 to 20,000 words."""
    model = language.train(docs.where("doc_id < 1000"))
    rng = random.Random(6)
    alphabets = [[chr(i) for i in range(a, b)] for a, b in ((0x3B1, 0x3C9), (0x430, 0x44F), (0x627, 0x64A), (0x3041, 0x3093), (0x4E00, 0x9FA0), (0xAC00, 0xD7A3))]
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(n))
    foreign = [text(letters, n) for letters in alphabets for n in (2, 10, 50, 800, 20_000)] + [text("kvwxyzj", n) for n in (50, 800, 20_000)]
    own = [" ".join(docs.where(f"doc_id < 1000 and lang = '{x}' and length(text) > 400").first()["text"] for _ in range(n)) for x in ("en", "fr", "de") for n in (1, 20, 200)]
    rows = spark.createDataFrame(list(enumerate(foreign + own)), "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in language.identify(rows, model).collect()}
    assert [i for i in range(len(foreign)) if not got[i]] == []
    assert not any(got[len(foreign) + i] for i in range(len(own)))


def test_language_scores_equal_a_plain_reading(spark, docs):
    """Each text by itself: n-grams by a loop, cosines by the formula."""
    model = language.train(docs)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}

    def bins(text):
        spaced = re.sub(r"\0+", "\0", "\0" + "".join(c if c.isalpha() else "\0" for c in text.lower()) + "\0")
        out = collections.Counter()
        for n in (1, 2, 3):
            for i in range(len(spaced) - n + 1):
                h = (ord(spaced[i]) * 0x9E3779B1) % 2**32
                for c in spaced[i + 1 : i + n]:
                    h = ((h ^ (h >> 15)) * 0x85EBCA6B + ord(c) * 0x9E3779B1) % 2**32
                out[((h ^ (h >> 13)) * 0xC2B2AE35 % 2**32) >> 20] += 1
        return out

    for r in docs.where("doc_id < 60 or doc_id >= 1000").collect():
        text = r["text"] or ""
        if not any(c.isalpha() for c in text):
            continue
        vector = {b: math.log1p(n) * float(model.idf[b]) for b, n in bins(text).items()}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        cosines = [sum(v * float(c[b]) for b, v in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=lambda i: cosines[i])
        assert got[r["doc_id"]]["score"] == pytest.approx(cosines[best], abs=1e-4)
        assert got[r["doc_id"]]["lang_pred"] == model.langs[model.owner[best]] or sorted(cosines)[-1] - sorted(cosines)[-2] < 1e-4


def test_language_rejects_what_is_hardly_text(spark, docs):
    model = language.train(docs.where("doc_id < 1000"))
    junk = ["1234 !!! a", "x", "0x3f 99 ## 12,5 | 7 % e", "2024-01-01 12:00:00 GET 200 0.004", "=== *** --- the --- *** ===" * 40]
    rows = spark.createDataFrame(list(enumerate(junk)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    got = [r["rejected"] for r in sorted(language.identify(rows, model).collect())]
    assert got[0] and all(got[2:])


def test_language_sample_is_bounded(spark, monkeypatch):
    """Null ids and a text that most rows share: the driver gets few rows."""
    rows = [(None, "the same words in every one of these rows", "en") for _ in range(3000)] + [(i, f"der die das {i} nicht ein und", "de") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    sizes = []
    monkeypatch.setattr(language, "fit", lambda names, labels, *a: sizes.append(len(labels)) or None)
    language.train(frame, max_train=100)
    assert 50 <= sizes[0] <= 51
    assert language.train(frame, max_train=100, max_langs=1) is None and sizes[1] <= 100


def test_language_without_labels_or_rows(empty, docs, clashing):
    assert language.identify(empty).count() == 0 and language.keep_identified(empty).count() == 0
    none = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    kept = language.keep_identified(clashing)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()


# --- decontamination -----------------------------------------------------------


def greedy(text, item, least):
    """Greedy string tiling by the book."""
    used_t, used_p, out = [False] * len(text), [False] * len(item), 0
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not used_p[p + n] and not used_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return out
        for k in range(n):
            used_p[p + k] = used_t[t + k] = True
        out += n


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        text, item = [rng.randrange(4) for _ in range(rng.randint(0, 40))], [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        if rng.random() < 0.5 and len(item) > 10:
            text = item[6:] + text[:5] + item[:6]
        found = decontaminate.tiles(np.array(text, np.uint64), np.array(item, np.uint64), 3)
        assert sum(n for *_, n in found) == greedy(text, item, 3), (text, item)
        spans_t = sorted((a, a + n) for a, _, n in found)
        spans_p = sorted((b, b + n) for _, b, n in found)
        assert all(x[1] <= y[0] for s in (spans_t, spans_p) for x, y in zip(s, s[1:], strict=False))


def planted(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(6)] + [(50, "too short"), (51, None), (None, " ".join(word() for _ in range(30)))]
    noise = lambda n: " ".join(word() for _ in range(n))
    text = dict(items)
    words = text[2].split()
    docs = [
        (0, noise(200)), (1, noise(50) + " " + text[1] + " " + noise(50)), (2, " ".join(words[20:] + noise(9).split() + words[:20])), (3, " ".join(words[:12]) + " " + noise(60)), (4, text[3].upper().replace(" ", "\n\t ")),
        (5, None), (6, ""), (7, "too short"), (8, text[4] + " " + text[5]), (9, " ".join(w if i % 4 else "gap" for i, w in enumerate(words))), (10, text[None]),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_leaks_are_found(spark, limit):
    docs, items = planted(spark)
    got = {r["doc_id"]: r for r in decontaminate.contaminated(docs, items, broadcast_bytes=limit).collect()}
    assert {i for i, r in got.items() if not r["kept"]} == {1, 2, 4, 8} and len(got) == 11
    assert (got[2]["item_id"], got[2]["coverage"], got[2]["n_tiles"]) == (2, 1.0, 2) and got[8]["n_items"] == 2 and got[8]["item_id"] == 4
    assert got[0]["item_id"] is None
    kept = decontaminate.drop_contaminated(docs.withColumn("print", F.lit(1)), items, broadcast_bytes=limit)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 5, 6, 7, 9, 10] and kept.columns == ["doc_id", "text", "print"]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_each_row_is_judged_by_its_own_text(spark, limit):
    _, items = planted(spark)
    leak = items.where("item_id = 1").first()["text"]
    clean = " ".join(f"clean{i}" for i in range(60))
    docs = spark.createDataFrame([(7, leak), (7, clean), (7, leak), (None, leak), (None, clean), (None, None), (8, clean)], "doc_id long, text string")
    got = decontaminate.contaminated(docs, items, broadcast_bytes=limit).collect()
    assert sorted((r["doc_id"] or 0, r["kept"], r["item_id"] or 0) for r in got) == [(0, False, 1), (0, True, 0), (0, True, 0), (7, False, 1), (7, False, 1), (7, True, 0), (8, True, 0)]
    kept = decontaminate.drop_contaminated(docs, items, broadcast_bytes=limit).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, ""), (0, clean), (7, clean), (8, clean)]


def test_leaks_of_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).where("kept").count() == docs.count()
    assert decontaminate.contaminated(empty, none).count() == 0


# --- quality -------------------------------------------------------------------


def test_base_columns_equal_brute_force(docs):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    for row in docs.collect():
        t, r = row["text"] or "", got[row["doc_id"]]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and r["kept"] == (not r["base_failed"])


def test_lines_are_labelled(spark):
    rng = random.Random(1)
    good = lambda: "\n".join(" ".join(rng.choice("alpha beta gamma delta house river".split()) + rng.choice("abc") for _ in range(12)).capitalize() + "." for _ in range(rng.randint(1, 9)))
    bad = lambda: "\n".join(" | ".join("".join(rng.choice("abcdef") for _ in range(6)) for _ in range(12)) for _ in range(rng.randint(1, 9)))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 200] + [(None, 1), (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    held = [i for i in range(200, 300) if not got[i]["base_failed"]]
    assert held and all(got[i]["kept"] == bool(i % 2) for i in held)
    alike = quality.quality(docs, labels.where("quality = 1")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in alike)


def test_quality_of_held_out_documents(spark):
    """Two in three labelled documents train; the verdicts on the others agree
    with their labels nearly always."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    seen = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1")
    got = {r["doc_id"]: r["kept"] for r in quality.quality(docs, seen).collect()}
    held = {r["doc_id"]: r["quality"] for r in labels.where("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1").collect()}
    good, bad = [i for i, q in held.items() if q == 1], [i for i, q in held.items() if q == 0]
    assert sum(got[i] for i in good) >= 0.93 * len(good) and sum(not got[i] for i in bad) >= 0.85 * len(bad)


def test_decoding_equals_all_paths():
    rng = np.random.default_rng(2)
    field = quality.LineField(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    lens = [0, 3, 1, 6, 0, 5, 6, 0]
    first = np.concatenate(([0], np.cumsum(lens)))
    x = rng.normal(size=(first[-1], quality.N_FEATURES)).astype(np.float32)
    got = field.decode(x, first)
    s = x @ field.weights
    for a, b in zip(first[:-1], first[1:], strict=True):
        paths = [[(m >> k) & 1 for k in range(b - a)] for m in range(2 ** (b - a))]
        value = lambda p, a=a: sum(s[a + i, y] for i, y in enumerate(p)) + sum(field.moves[u, v] for u, v in zip(p, p[1:], strict=False))
        assert got[a:b].tolist() == max(paths, key=value)


def test_quality_of_nothing(empty, clashing):
    assert quality.quality(empty, empty.selectExpr("doc_id", "1 as quality")).count() == 0
    assert quality.quality(clashing).count() == clashing.count()


# --- language model ------------------------------------------------------------


def test_scores_equal_counts(docs, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HEAD", 40)
    monkeypatch.setattr(lm_scoring, "VOCAB", 20)
    got = sorted(lm_scoring.score_documents(docs).collect(), key=repr)
    rows = docs.collect()
    tokens = {r["doc_id"]: [*plain_words(r["text"]), None] for r in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, own in tokens.items() if not held[i] for w in own)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def test_model_beats_frequencies_on_held_out_text(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1200):
        own = [f"{'xyz'[i % 3]}{k}" for k in range(40)]
        rows.append((i, " ".join(rng.choice(own) for _ in range(60))))
    got = [r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


@pytest.fixture(scope="module")
def driver_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()


@pytest.mark.parametrize("parts", [1, 9, 64])
def test_model_learns_at_any_layout(driver_docs, parts):
    """Held-out documents, however the files are cut up."""
    held = [r for r in lm_scoring.score_documents(driver_docs.repartition(parts)).collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in held)
    gain = sum(r["score"] - r["base_score"] for r in held) / n
    SEEN.append(gain)
    assert gain >= 0.15 and max(SEEN) - min(SEEN) < 0.01


SEEN: list[float] = []


def test_several_shards_learn_too(driver_docs, monkeypatch):
    """The tree of averages: four shards, which meet two by two."""
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", 80_000)
    monkeypatch.setattr(lm_scoring, "FAN_IN", 2)
    held = [r for r in lm_scoring.score_documents(driver_docs).collect() if r["held_out"]]
    assert sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held) > 0.02


def test_scores_equal_a_plain_reading_of_the_model(docs):
    """Every word by itself, with the formulas written out."""
    some = docs.where("doc_id < 40 or doc_id >= 1000")
    fitted = lm_scoring.fit(some)
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(some, fitted).collect()}
    m, lex, k = fitted.model, fitted.lexicon, fitted.model.hidden
    x, u, c, cb, o, ob = (v.astype(np.float64) for v in (m.x, m.u, m.c, m.cb, m.o, m.ob))
    freq = {r["h"]: r["c"] for r in fitted.counts.collect()}
    vocab = {int(h): i for i, h in enumerate(lex.vocab_keys)}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for r in some.collect():
        tokens, _ = lm_scoring.token_hashes(*_text.buffers(pa.array([r["text"]], pa.string())))
        h, row, total = np.zeros(k), lex.n_vocab + lm_scoring.TAIL_CLASSES, 0.0
        for t in tokens.tolist():
            a = h @ u
            gate, z = sigmoid(x[row][:k] + a[:k]), sigmoid(x[row][k : 2 * k] + a[k : 2 * k])
            h = (1 - z) * np.tanh(x[row][2 * k :] + gate * a[2 * k :]) + z * h
            tail = t % lm_scoring.TAIL_CLASSES
            row = vocab.get(t, lex.n_vocab + tail)
            logits = c @ h + cb
            total += logits[lex.class_of[row]] - math.log(np.exp(logits).sum())
            if row < lex.n_vocab:
                lo, hi = lex.class_first[lex.class_of[row]], lex.class_first[lex.class_of[row] + 1]
                total += (o @ h + ob)[row] - math.log(np.exp((o[lo:hi] @ h) + ob[lo:hi]).sum())
            else:
                total += math.log((freq.get(t, 0) + 1) / (fitted.tail_n[tail] + fitted.tail_v[tail] + 1))
        assert got[r["doc_id"]] == pytest.approx(total / math.log(10), rel=1e-4, abs=1e-3)


def test_probabilities_add_up():
    """Over a closed vocabulary the classes and words sum to one at every state."""
    keys = np.arange(100, dtype=np.int64) * 977 + 5
    lex = lm_scoring.Lexicon(keys, np.arange(1, 101), vocab=30, classes=4)
    model = lm_scoring.Gru(lex, tail_counts=np.ones(lm_scoring.TAIL_CLASSES))
    state = np.random.default_rng(0).normal(size=(1, model.hidden)).astype(np.float32)
    n = lex.n_vocab + lm_scoring.TAIL_CLASSES
    logp, _ = model.outputs(np.repeat(state, n, 0), np.arange(n))
    assert np.exp(logp.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    keys = np.arange(60, dtype=np.int64) * 31
    lex = lm_scoring.Lexicon(keys, rng.integers(1, 50, 60), vocab=25, classes=3)
    model = lm_scoring.Gru(lex)
    model.flat += rng.normal(0, 0.3, len(model.flat)).astype(np.float32)
    texts = [(i, rng.integers(0, lex.n_vocab + lm_scoring.TAIL_CLASSES, 20)) for i in range(8)]
    grads, flat = {}, np.zeros_like(model.flat)
    model.views(flat, grads)

    def step(keys, x, y, states, kept):
        mask = y >= 0
        _, dh = model.outputs(states[mask], y[mask], grads)
        d = np.zeros_like(states)
        d[mask] = dh
        model.backward(x, kept, d, grads)

    lm_scoring._run(model, texts, step)
    for i in np.argsort(-np.abs(flat))[:: len(flat) // 25][:12]:
        keep, e = model.flat[i], 4e-3
        model.flat[i] = keep + e
        up = sum(lm_scoring.score_on(model, texts).values())
        model.flat[i] = keep - e
        down = sum(lm_scoring.score_on(model, texts).values())
        model.flat[i] = keep
        assert (up - down) / (2 * e) == pytest.approx(flat[i], rel=0.05, abs=0.05)


def test_states_are_carried_whole():
    """Scores do not depend on the window or on which texts run side by side."""
    rng = np.random.default_rng(4)
    lex = lm_scoring.Lexicon(np.arange(40, dtype=np.int64), rng.integers(1, 9, 40), vocab=20, classes=3)
    model = lm_scoring.Gru(lex)
    texts = [(i, rng.integers(0, 20, n)) for i, n in enumerate([1, 90, 7, 30, 24, 25, 49])]
    one = lm_scoring.score_on(model, texts)
    out = {}

    def step(keys, x, y, states, kept):
        mask = y >= 0
        lp = np.zeros(y.shape)
        lp[mask] = model.outputs(states[mask], y[mask])[0]
        for key, s in zip(keys, lp.sum(0), strict=True):
            out[key] = out.get(key, 0) + s

    lm_scoring._run(model, texts, step, window=5, slots=2)
    assert all(out[i] == pytest.approx(one[i], rel=1e-4) for i in one)


def test_scores_of_nothing(spark, empty, clashing):
    assert lm_scoring.score_documents(empty).count() == 0
    assert lm_scoring.score_documents(clashing).count() == clashing.count()
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    only = lm_scoring.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (only["n_known"], only["train_tokens"], only["base_score"]) == (0, 0, 0.0)


def test_hash_identity():
    data, offsets = _text.buffers(pa.array(["Word word WORD", None, ""]))
    tokens, first = lm_scoring.token_hashes(data, offsets)
    assert len(set(tokens[:3].tolist())) == 1 and tokens[3] == lm_scoring.END and first.tolist() == [0, 4, 5, 6]
    assert "Word".encode().translate(LOWER) == b"word"

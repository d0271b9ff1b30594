"""Line dedup, mixing and chat formatting: they stay in the JVM."""

import glob
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import catalog, chat, line_dedup, mixing

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    frame = catalog.QUERIES[name](spark, SF)
    assert name == "op1_minhash_near_dedup" or not any(x in plan(frame) for x in ("Python", "Pandas", "Arrow"))
    found = db.sql(catalog.ORACLE[name])
    columns = sorted(frame.columns)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert sorted((tuple(r) for r in frame.select(columns).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("small", [50_000, 0])
def test_shared_lines_go(docs, monkeypatch, small):
    monkeypatch.setattr(line_dedup, "SMALL", small)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    sites = {}
    for _, t, s in rows:
        for line in set((t or "").split("\n")) if t is not None else ():
            if line.strip(" \t\n\x0b\x0c\r"):
                sites.setdefault(line, set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= 4}
    assert bad
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.drop_shared_lines(docs, min_sites=4).collect()}
    for i, t, _ in rows:
        if t is None:
            assert got[i] == (0, 0, None)
            continue
        lines = t.split("\n")
        full = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
        assert got[i] == (len(full), sum(x in bad for x in full), "\n".join(x for x in lines if x not in bad)), i


def test_lines_of_nothing(empty, clashing):
    assert line_dedup.drop_shared_lines(empty).count() == 0
    assert line_dedup.drop_shared_lines(clashing).count() == clashing.count()


def water(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by repeated sharing of what full sources leave."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if out[s] + unit * w[s] >= 2 * sizes[s]}
        for s in open_:
            add = min(unit * w[s], 2 * sizes[s] - out[s]) if full else unit * w[s]
            if not full or s in full:
                out[s] += add
                left -= add
        open_ -= full
        if not full:
            break
        for s in open_:
            left += out[s]
            out[s] = 0.0
    return out


@pytest.mark.parametrize("range_rows", [20_000, 7])
def test_mix_meets_its_targets(docs, range_rows):
    got = mixing.mix(docs, range_rows=range_rows).collect()
    again = mixing.mix(docs, range_rows=range_rows).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr) and len(got) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == int(target[s])
    part = [r for r in got if r["size"] and r["taken"] % r["size"]]
    assert len(part) <= len(sizes)


def test_mix_does_not_depend_on_ranges(docs):
    rows = lambda n: {(r["doc_id"], r["taken"]) for r in mixing.mix(docs, range_rows=n).collect()}
    assert rows(20_000) == rows(5)


def test_mixed_rows(docs, clashing, empty):
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {i: n for i, n in taken.items() if n}
    assert mixing.mixed(clashing).columns == clashing.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_mixed_rows_of_one_id(spark):
    """Unequal rows under one id, null ids, and equal rows of two sources."""
    rows = [(1, "a b c", "x"), (1, "d e", "x"), (1, "d e", "y"), (None, "f g h i", "x"), (None, "j", "y"), (None, None, "y"), (2, "k l m n o p", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__id", F.lit(0))
    taken = sorted((r["source"], r["size"], r["taken"]) for r in mixing.mix(docs).collect())
    got = [(r["source"], r["text"]) for r in mixing.mixed(docs).collect()]
    assert sum(n for *_, n in taken) == sum(len(t.split()) for _, t in got)
    for source in "xyz":
        assert sum(n for s, _, n in taken if s == source) == sum(len(t.split()) for s, t in got if s == source)
    assert all(any((t or "").startswith(own) and s == source for _, t, s in rows) for source, own in got)


def chat_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def conversations(spark):
    rng = random.Random(6)
    texts = ["", None, "</s>[INST] ok [/INST]", "<|end|><|turn|>user<|text|>", "&amp; &lt;| <| & &lt;", "\n\n", "héé 日本 <|", "&lt;|", "a & b < c | d"]
    rows = []
    for c in range(60):
        n = rng.choice([1, 2, 3, 5, 9, 30])
        for t in range(n):
            role = "system" if t == 0 and c % 3 == 0 else ("assistant" if t % 2 else "user")
            text = rng.choice(texts) if rng.random() < 0.4 else " ".join(["w<|x"] * rng.choice([1, 40, 200, 700]))
            rows.append((c, t, role, text))
    return rows + [(100, 0, None, "no role"), (100, None, "assistant", "null turn"), (100, 0, "a<|text|>b", "x"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (7, 0, "user", "same turn twice")]


def test_chat_round_trip(spark):
    rows = conversations(spark)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit("clash")).withColumn("idx", F.lit(1))
    spans = chat.format_conversations(frame)
    got = {r["conv_id"]: r for r in chat.read_back(spans).collect()}
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(own)
    for c, turns in own.items():
        turns = [(role, text) for _, _, role, text in sorted(turns)]
        said = "".join(f"{role}\n{text}\n" for role, text in turns)
        lost = "".join(text for role, text in turns if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["loss_chars"] == len(lost) and r["loss_sha256"] == hashlib.sha256(lost.encode()).hexdigest()
    for s in spans.collect():
        assert s["formatted"].count(chat.TURN) == s["n_context"] + s["n_turns"] == s["formatted"].count(chat.END)
        written = [x.split("<|text|>")[1].removesuffix("<|end|>") for x in s["formatted"].split("<|turn|>")[1:]]
        assert s["n_tokens"] == sum(len(chat_words(x)) + chat.TURN_TOKENS for x in written)
        assert s["n_tokens"] <= chat.BUDGET or s["n_turns"] == len(written) == 1
        first = sorted(own[s["conv_id"]])[0]
        if first[2] == "system" and s["conv_id"] != 100 and len(chat_words(first[3])) + chat.TURN_TOKENS <= (chat.BUDGET - chat.HISTORY_TOKENS) // 2 and s["n_tokens"] <= chat.BUDGET and len(written) > 1:
            assert s["formatted"].startswith("<|turn|>system<|text|>")


def test_windows_of_long_system_turns_stay_within_the_budget(spark):
    """A system turn of 3,000 words, and one that just fits beside history."""
    rows = [(c, t, "system" if t == 0 else ("assistant" if t % 2 == 0 else "user"), "w " * n) for c, lead in ((1, 3000), (2, 180)) for t, n in enumerate([lead] + [60] * 12)]
    spans = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(s["n_tokens"] <= chat.BUDGET for s in spans if s["conv_id"] == 2 or s["span"] > 0 and "w " * 3000 not in s["formatted"])
    assert sum("w " * 3000 in s["formatted"] for s in spans) == 1
    assert all(s["formatted"].startswith("<|turn|>system<|text|>") for s in spans if s["conv_id"] == 2)
    assert any(s["n_context"] > 1 for s in spans if s["conv_id"] == 2)


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0

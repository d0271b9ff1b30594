import random

import numpy as np
import pytest

from conftest_data import LOWER

from tidewheel.llm import near_dedup
from tidewheel.llm.components import connected_components



def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """doc_id -> smallest doc_id reachable over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}, dict(sets)


def check(found, rows):
    parent, sets = brute(rows)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
            continue
        assert (r["component_id"], r["kept"]) == (parent[r["doc_id"]], parent[r["doc_id"]] == r["doc_id"]), r
        assert r["n_shingles"] == len(sets[r["doc_id"]])


def test_equals_brute_force(docs):
    check(near_dedup.near_duplicates(docs), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("limit, posted", [(2, 20), (3, 4)])
def test_long_lists_lose_nothing(spark, monkeypatch, limit, posted):
    """A group of near copies, chains of copies, and a passage in most documents,
    with lists so short that nearly all count as long."""
    monkeypatch.setattr(near_dedup, "LIST_LIMIT", limit)
    monkeypatch.setattr(near_dedup, "POSTED", posted)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    rows = []
    for i in range(40):
        own = list(base)
        own[rng.randrange(120)] = word()
        rows.append((i, " ".join(own)))
    chain = list(base[:100]) + [word() for _ in range(100)]
    for i in range(40, 60):
        chain[(i * 7) % 200] = word()
        rows.append((i, " ".join(chain)))
    for i in range(60, 100):
        rows.append((i, " ".join(passage + [word() for _ in range(rng.choice([30, 90]))])))
    rows += [(100 + i, rows[60 + i][1] + " tail") for i in range(10)]
    check(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def links_of(rows):
    """All linked pairs of (id, text) rows and the smallest id reachable, by a
    matrix product of all sets with all sets."""
    names, sets = [i for i, _ in rows], [shingles(t) for _, t in rows]
    place = {s: k for k, s in enumerate(sorted(set().union(*sets)))}
    has = np.zeros((len(rows), len(place)), np.float32)
    for k, s in enumerate(sets):
        has[k, [place[x] for x in s]] = 1
    both, n = has @ has.T, has.sum(1)
    linked = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    low = np.array(names)
    while True:
        new = np.where(linked, low[None, :], 2**62).min(1)
        if (new == low).all():
            return int((linked.sum() - len(rows)) // 2), dict(zip(names, low.tolist(), strict=True))
        low = new


def recall(spark, rows):
    """Share of documents with the right component, at the constants as they are."""
    n, want = links_of(rows)
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return n, sum(r["component_id"] == want[r["doc_id"]] for r in found) / len(rows)


def test_recall_in_a_large_group_of_near_copies(spark):
    """2,000 copies whose similarities to one another lie around 0.75, among
    other texts: every list of the group is long."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        own = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            own[rng.randrange(120)] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    rows += [(5000 + i, " ".join(f"d{rng.randrange(500)}" for _ in range(60))) for i in range(200)]
    n, share = recall(spark, rows)
    assert n > 100_000 and share == 1


def test_recall_in_a_long_chain(spark):
    """Each text is similar to its neighbours only, and most lists are long."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 100])) for i in range(300)]
    rng.shuffle(rows)
    n, share = recall(spark, rows)
    assert n > 300 and share == 1


def test_recall_of_texts_made_of_shared_passages(spark):
    """Ten of twenty shared passages each: nearly all lists are long, and most
    of the texts that share them are no copies."""
    rng = random.Random(13)
    pieces = [" ".join(f"p{k}_{rng.randrange(10**6)}" for _ in range(40)) for k in range(20)]
    rows = [(i, " ".join(rng.sample(pieces, 10))) for i in range(700)]
    rows += [(1000 + i, rows[i][1] + " and a tail of its own") for i in range(0, 700, 50)]
    n, share = recall(spark, rows)
    assert n >= 14 and share == 1


def test_one_id_with_two_texts_near_to_others(spark):
    """Two texts of one id with equally many shingles, each near to another row."""
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (8, " ".join([*b, "x"]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {5}


def test_empty_table(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).columns == empty.columns


def test_repeated_rows_and_other_columns(clashing):
    rows = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    parent, _ = brute(rows)
    found = near_dedup.near_duplicates(clashing).collect()
    assert len(found) == len(rows) and all(r["component_id"] == parent[r["doc_id"]] for r in found)
    kept = near_dedup.drop_near_duplicates(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in parent.items() if i == p)


def test_one_id_with_two_texts(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = spark.createDataFrame([(5, a), (5, b), (1, a), (9, b)], "doc_id long, text string")
    assert {r["component_id"] for r in near_dedup.near_duplicates(rows).collect()} == {1}


def test_one_id_with_two_texts_of_one_length(spark):
    """Each text has near copies of its own, and the id is the smallest of both."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (5, " ".join([*a, "tail"])), (9, " ".join([*b, "tail"]))]
    assert {r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(n, n) == root(n) for n in parent)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0

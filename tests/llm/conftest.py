"""Small tables for the operators: odd cases that each of them must take."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = {
    "en": "the and of to in that is was he for it with as his on be at by had not are but from or have an they which".split(),
    "fr": "le la les des une dans que pour qui sur avec est pas plus par au ce il sont été même être où déjà après".split(),
    "de": "der die und das nicht ein eine mit für auf ist sich von dem werden haben über schön größer müssen zwölf".split(),
}


def prose(rng, lang, n, lines=4):
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", rng.choice("abcdefgh") * 2]) for _ in range(n)]
    cut = max(1, n // lines)
    return "\n".join(" ".join(words[i : i + cut]).capitalize() + "." for i in range(0, n, cut))


def corpus(n=150, seed=1):
    """Prose in three languages with exact copies, near copies and a shared passage."""
    rng = random.Random(seed)
    shared = prose(rng, "en", 30, 1)
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", "de"])
        kind = rng.random()
        if rows and kind < 0.15:
            _, text, lang, *_ = rng.choice(rows)
        elif rows and kind < 0.35:
            _, text, lang, *_ = rng.choice(rows)
            words = text.split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = prose(rng, lang, rng.choice([3, 20, 80, 200, 400]))
            if rng.random() < 0.3:
                text += "\n" + shared
        rows.append((i, text, lang, f"src{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}", len(text)))
    return rows


ODD = [
    (1000, None, None, None, None),
    (1001, "", "en", "src0", 0),
    (1002, " \t\n\x0b\x0c\r ", "en", None, 7),
    (1003, "one", "en", "src1", 3),
    (1004, "one two three four", "en", "src1", 18),
    (1005, "one two three four", None, "src2", 18),
    (1006, "12 34 !! -- 56", "fr", "src2", 14),
    (1007, "word " * 3000, "en", "src0", 15000),
    (1008, "x" * 20000, "en", "src0", 20000),
    (1009, "日本語 の テキスト です 。 中文 字符", "fr", "src3", 20),
    (1010, "\n\n\n", "de", "src3", 3),
    (1011, "nul \x00 inside and more words here", "en", "src1", 30),
    (None, "a text without an id but with some words", "en", "src1", 40),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus() + ODD, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Columns with names the operators use inside, and repeated rows."""
    rows = [(*r, 1, "k", "v", [1]) for r in corpus(12, 5)]
    return spark.createDataFrame(rows + rows[:3], SCHEMA + ", id long, key string, h string, sk array<int>")

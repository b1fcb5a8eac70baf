"""Fixtures of the training-data operators."""

import random

import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from connrisk.llm.common import start

    return start(spark)


@pytest.fixture(scope="session")
def prose():
    """A maker of seeded invented prose."""

    def make(seed: int, words: int, vocabulary: int = 400) -> str:
        rng = random.Random(seed)
        names = ["".join(rng.choice(["th", "er", "an", "ou", "le", "ñ", "é", "st"]) for _ in range(rng.randint(1, 4)))
                 for _ in range(vocabulary)]
        return "".join(rng.choice(names) + rng.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def documents(prose):
    """Documents with every awkward case: nulls, empty and blank texts, a very
    long text, exact and near copies, a hot line, repeated rows, ties."""
    rows = [(0, None), (1, ""), (2, " \t\n\n"), (3, "short"), (4, "One two"), (5, "one TWO"), (6, "a" * 300), (7, "a" * 260)]
    line = "This very line stands in a great many documents here."
    rows += [(10 + i, prose(i, 40 + 3 * i) + "\n" + line) for i in range(30)]
    base = prose(99, 300)
    words = base.split(" ")
    rows += [(100, base), (101, base), (102, " ".join(words[:-1] + ["new"])), (103, " ".join(["new"] + words[1:])),
             (104, " ".join(words[:150])), (105, base.upper())]
    rows += [(200, prose(7, 6000)), (201, prose(7, 6000) + " tail")]
    rows += [(10, rows[8][1]), (300, "  This very line stands in a great many documents here.\t\nown line of its own\n\nown line of its own")]
    return rows


@pytest.fixture(scope="session")
def docs(llm, documents):
    """The documents as a table with extra columns whose names clash with inner ones, in five partitions."""
    wide = [(i, t, "x", 7, 1.5, "k") for i, t in documents]
    return llm.createDataFrame(wide, "doc_id long, text string, sid string, n int, h1 double, row_key string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def null_docs(llm):
    """Nulls in every column, twice."""
    return llm.createDataFrame([(None, None, None, None, None)] * 2 + [(None, "some text of its own, long enough for a window of bytes", None, None, None)] * 2,
                               "doc_id long, text string, lang string, source string, n_chars long")

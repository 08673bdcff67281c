import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rep long, key string, label int, t long, n long, bytes long, first long, words string"


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(400)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty and long texts, ties, repeated rows and ids, near copies, and columns of clashing names."""
    rng = random.Random(7)
    base = words(rng, 120)
    parts = base.split(" ")
    near = [" ".join(parts[:k] + ["changed"] + parts[k + 1 :]) for k in (0, 60, 119)]
    passage = words(rng, 90)
    texts = [
        (5, base), (3, base.upper()), (9, base), (4, near[0]), (12, near[1]), (2, near[2]), (7, None), (8, ""), (6, " \t\n "), (10, "one two"), (11, "One  two"),
        (20, f"{words(rng, 60)} {passage} {words(rng, 3)}"), (21, f"{passage} {words(rng, 40)}"), (22, passage), (22, passage), (30, words(rng, 20000)), (31, "word"),
        (None, base), (None, None), (40, "é" * 40 + base[:300]), (41, "é" * 40 + base[:300].replace(" ", "\n")), (-1, "x " * 300), (50, base), (50, passage),
    ]
    rows = []
    for k, (i, text) in enumerate(texts):
        rows.append((i, text, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, 1, "k", 0, 2, 3, 4, 5, "w"))
    return rows


@pytest.fixture
def awkward_docs(spark, awkward):
    return spark.createDataFrame(awkward, COLUMNS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)

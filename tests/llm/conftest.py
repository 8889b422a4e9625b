import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    """Nulls, empty and blank texts, repeated rows, ties, near copies, shared lines, one long text."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    common = "This very line is held by many documents, and it is long enough to go."
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 25))) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(1, ("  " if i % 8 else "") + common.upper() if i % 3 else common + "\t")
        rows.append((i, "\n".join(lines), "en" if i % 3 else "de", ["a", "b", None, "Ž"][i % 4]))
    base = rows[7][1] + " " + rows[8][1]
    for i in range(60, 72):  # near copies: a few words differ
        w = base.split(" ")
        w[i % len(w)] = f"changed{i}"
        rows.append((i, " ".join(w), "en", "a"))
    rows += [(72, base, "en", "b"), (73, base, "en", "b"), (73, base, "en", "b")]
    rows += [(74, None, None, None), (75, "", "en", "a"), (76, " \t\n ", "de", "b"), (77, "\n\n", None, "c"), (78, "123 456", "en", "c"), (79, "one", "en", "c"), (80, "one", "en", "c")]
    rows += [(81, "Ünï códe ﬁ   x́ 😀 " * 3, "de", "d"), (82, " ".join(rng.choice(words) for _ in range(9000)), "en", "a"), (None, "a text without an id", "en", "a"), (None, None, None, None)]
    return [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)

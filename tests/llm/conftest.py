from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeiounrtsl") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents with copies, near copies, shared lines, secrets and every odd case."""
    rng = random.Random(5)
    shared = words(rng, 30)
    out: list[tuple] = []
    for i in range(60):
        lines = [words(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if i % 6 == 0:
            lines.insert(1, shared)
        if i % 7 == 0:
            lines.append(f"password={rng.getrandbits(80):020x} and AKIA{'ABCDEFGHIJ234567'[:16]}")
        out.append((i, "\n".join(lines), "en", ["b", "a", None, "c"][i % 4], 0))
    for i in range(60, 80):  # copies, some with changes of a word or of a letter
        text = out[i - 60][1]
        if i % 3 == 1 and len(text) > 60:
            text = text[:30] + ("x" if text[30] != "x" else "y") + text[31:]
        elif i % 3 == 2:
            w = text.split(" ")
            text = " ".join([*w[:-1], "other"])
        out.append((i, text, "en", "a", 0))
    out += [(80, None, None, None, None), (81, "", "en", "a", 0), (82, " \n\t\n ", "en", "b", 5), (83, "one", "en", "b", 3), (84, "One two", "en", "b", 7), (85, "one  TWO", "en", "a", 8), (86, "ünï ß 漢字 \U0001f600 é", "de", "a", 0), (87, "a" * 30_000, "en", "a", 0), (88, "na na " * 5_000, "en", "a", 0)]
    return [(a, b, c, d, None if b is None else len(b)) for a, b, c, d, _ in out]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null and repeated ids, repeated rows, and columns whose names clash with those of operators."""
    rows = [(1, "same text here for all of us", "a", 1, 2), (1, "same text here for all of us", "a", 1, 2), (None, "no id\nat all", None, 3, 4), (None, None, "a", 5, 6), (2, "x y z", "b", 7, 8)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score long, key long").selectExpr("*", "'en' AS lang", "cast(length(text) as long) AS n_chars", "0 AS size", "0 AS node")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)

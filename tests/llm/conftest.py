"""Tables for the training-data operators: every awkward case in a few rows."""

from __future__ import annotations

import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, block int, hash long, twin string"


def words(rng: random.Random, n: int) -> str:
    syllables = ["th", "on", "er", "ing", "ré", "ß", "ou", "st", "ha", "ль"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    """With columns whose names clash with those that operators use."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7, None, "x")


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    passage = words(rng, 60)
    out = [
        row(0, None), row(1, ""), row(2, " \t\n"), row(3, "one"), row(4, "one two"), row(5, words(rng, 100), None, None),
        row(6, passage), row(7, words(rng, 40) + "\n" + passage + " " + words(rng, 5), "fr", "b"), row(8, passage + " " + passage, "xx", "b"),
        row(9, " nbsp   em\x1cfs " + words(rng, 30)), row(10, "€" * 120), row(11, "A" * 70 + "B" + "A" * 70), row(12, "a" * 49), row(13, "a" * 50),
        row(14, "a" * 51, "de", "c"), row(None, passage, "es", None), row(None, None, None, None), row(6, passage), row(20, words(rng, 3000), "de", "c"),
    ]
    copy = words(rng, 80)
    out += [row(30 + k, copy, "en", "hot") for k in range(12)]
    near = copy.split()
    near[40] = "changed"
    out.append(row(50, " ".join(near), "en", "hot"))
    out += [row(60 + k, words(rng, rng.randint(1, 60)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "hot", None])) for k in range(40)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DDL)

"""Fixtures of the operators' tests: a table of awkward documents."""

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"

WORDS = "the of and river stone cloud garden winter silver copper train paper letter window morning evening".split()


def prose(n, seed):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing", str(rng.randint(1, 99))]) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, copies, near copies, tied and repeated rows; a column that clashes with outputs."""
    base = prose(300, 1)
    rows = [(1, base), (2, base), (3, base.replace("river", "rivers", 1)), (4, None), (5, ""), (6, " \n\t "), (7, "one"),
            (8, "One"), (9, prose(40_000, 2)), (10, prose(80, 3) + " " + base[:400]), (11, prose(60, 4)), (11, prose(60, 4)),
            (12, "Éa ß 日本語 🙂 " * 30), (13, "Éa ß 日本語 🙂 " * 30), (14, "9" * 5_000), (15, prose(90, 5).upper()), (16, prose(90, 5))]
    return spark.createDataFrame([(i, t, "x", 0.5, "en" if i % 2 else None) for i, t in rows],
                                 "doc_id long, text string, spans string, score double, lang string").repartition(4)


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.filter("false")

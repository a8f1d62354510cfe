import random

import pytest

WORDS = "the a of river stone light green under walks seven morning paper engine slow bright quiet north field market window".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty, very long, tied, repeated and near-equal texts."""
    rng = random.Random(7)
    base = sentence(rng, 300)
    near = base.split()
    near[150] = "changed"
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "One  TWO"), (6, base), (7, base), (7, base), (8, " ".join(near)), (None, "no id here"), (9, "naïve café — über 東京 \U0001f600 " * 3), (10, sentence(rng, 40000)), (11, "a" * 300000), (12, "İstanbul straße \x1c odd \x85 spaces \xa0 here"), (13, base + "\n \n  " + base)]
    return rows + [(100 + i, sentence(rng, rng.randint(1, 120))) for i in range(60)] + [(300 + i, base) for i in range(20)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    # extra columns whose names clash with those the operators make
    return spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in edge_rows], "doc_id long, text string, fp string, h string, part int, n int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")

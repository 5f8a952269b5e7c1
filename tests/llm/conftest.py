import random

import pytest

CLASHES = "rule string, quality_p string, keep string, id string, a string, b string, fp string, gone string, nth string, n_tokens string, block string, value string, held string"


def prose(seed: int, words: int) -> str:
    """Invented prose: common short words between rare long ones."""
    rng = random.Random(seed)
    rare = lambda: "".join(rng.choice(["ba", "ro", "tin", "mel", "dus", "ka", "vor", "ish"]) for _ in range(rng.randint(2, 4)))
    return " ".join(rng.choice(["the", "of", "and", "in", "to"]) if rng.random() < 0.4 else rare() for _ in range(words))


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing names."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, prose(1, 60)), (None, None), (4, prose(4, 60_000)), (5, prose(5, 80)), (5, prose(5, 80)), (6, prose(5, 80)), (7, "x" * 50_000), (8, prose(8, 80)), (8, prose(9, 80))]
    extra = CLASHES.count(",") + 1
    return spark.createDataFrame([(d, t, "en" if d else None, None, None, *["clash"] * extra) for d, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)

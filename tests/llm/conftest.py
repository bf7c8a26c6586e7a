import random

import pytest

WORDS = "the of and to in that house river green quick stone garden letter summer winter carries speaks über Straße naïve l'eau don't 12 3.5 , . ! ? ( )".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(99))]) for _ in range(n)]
    return " ".join(words)


LONG = prose(99, 9000)
#: doc_id, text: nulls, empty and blank texts, repeated rows and ids, a very long text, odd characters.
ROWS = [
    (1, prose(1, 120)), (2, prose(2, 60)), (3, prose(1, 120)), (4, ""), (5, None), (6, " \n\t "), (7, LONG), (8, "naïve ΟΔΟΣ İstanbul á é​ \x1cx\x1d 😀 <|endoftext|> \x00z"),
    (9, prose(9, 5)), (9, prose(9, 5)), (10, "one two"), (None, prose(3, 40)), (None, None), (11, prose(2, 60) + " end"), (14, prose(14, 300)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", 0, 1, "x", 2) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, piece int, sid string, block int").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(rows):
    return sorted(rows, key=repr)

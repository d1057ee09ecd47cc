"""Small documents with every awkward case: nulls, empty and long texts, copies, clashing columns."""

import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that the operators use inside or return.
    "ids string, token string, e string, group string, node string, n_words string, score string, key string, "
    "start string, shingle string, _words string, _row string"
)
EXTRAS = ("x",) * 12


def prose(seed: int, words: int) -> str:
    chance = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"]
    return " ".join("".join(chance.choices(syllables, k=chance.randint(1, 4))) for _ in range(words))


def awkward_rows() -> list[tuple]:
    base = prose(1, 120)
    near = " ".join(base.split()[:112] + prose(2, 8).split())
    rows = [
        (1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, prose(3, 60)),
        (8, prose(4, 4000)), (9, "one two three"), (10, "ONE two\tthree"), (11, "Thh " * 80),
        (12, "a <|endoftext|> b<|startoftext|>c"), (13, "I'll don't 12345 é́ 日本語 \U0001f389 \x1c\x85\xa0z"),
        (14, "\n".join(["same line here"] * 30 + [prose(5, 60)])), (None, prose(6, 80)), (None, base),
        (7, prose(3, 60)), (15, base.upper()), (16, "a" * 3000 + " " + " " * 3000 + "b"),
    ]
    langs = ["en", None, "fr"]
    return [(d, t, langs[k % 3], None if k % 4 else "s", None, *EXTRAS) for k, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (7, 1, None), (11, 0, 0), (11, 1, 0), (14, 0, 0), (None, 1, 0), (8, None, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

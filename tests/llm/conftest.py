import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "so", "tu") for b in ("ber", "dan", "fis", "gol", "hum") for c in ("", "t", "ing", "or", "el")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(rng: random.Random, lines: int = 4, words: int = 14) -> str:
    return "\n".join(sentence(rng, words) for _ in range(lines))


@pytest.fixture(scope="session")
def frame(spark):
    """Makes a documents table of (doc_id, text[, lang, source])."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] if len(r) > 2 else ("en", "s0")), None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls in each column, blank texts, repeated rows, equal ids, a very long text and a sign-only one."""
    rng = random.Random(5)
    same = text(rng)
    rows = [(1, same), (1, same), (2, None), (3, ""), (4, " \n\t\n"), (None, text(rng)), (None, None), (5, text(rng, 2, 30_000)), (6, "!!! ***"), (7, text(rng), None, None), (8, same), (8, text(rng)), (9, "x"), (10, "日本語 テキスト\r\né")]
    return frame(rows)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with more columns, named as what operators make themselves."""
    names = ("dest", "payload", "key", "line", "doc", "words", "score", "duplicate_of", "copy_of_group", "line_lost", "line_row", "line_text", "mix_rate", "mix_row", "copy_no", "quality", "id", "n", "sig", "part", "content_share", "upto", "before", "rate", "y", "label", "text2")
    return odd.withColumns({name: F.lit(k) for k, name in enumerate(names)})


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (7, 1, 0), (99, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")

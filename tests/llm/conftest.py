import datetime
import random

import pytest

WORDS = "the of and to in is that alpha beta gamma delta river stone cloud forest harbor lantern meadow orchard pebble quarry saddle timber valley willow".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = [rng.choice(WORDS) + ("." if i % 11 == 10 else "") for i in range(n)]
    return " ".join(out)


@pytest.fixture(scope="session")
def docs(spark):
    """Odd documents: null and empty texts, white space, long ones, ties, repeated rows, near copies,
    extra columns whose names clash with what operators add."""
    base = prose(1, 300)
    edited = base.replace("harbor", "haven", 1)
    rows = [
        (0, base, "en"), (1, base, "en"), (2, edited, "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "en"), (6, prose(2, 200), "en"), (7, "one two", "en"), (8, "ONE two", "en"),
        (9, prose(3, 20_000), "en"), (10, "### $$$ %%% ||| " * 40, None), (11, "12 345 !!", "en"), (12, "der die und das ist nicht " * 30, "de"), (13, "x" * 30_000, "en"), (14, prose(4, 80) + "\n" + prose(5, 80), "en"),
        (15, "ein mann und eine frau gehen nicht in das haus mit dem hund " * 8, "de"), (15, "ein mann und eine frau gehen nicht in das haus mit dem hund " * 8, "de"), (16, "　全角 文字　 🙂 a\x1cb  c\n d", "en"),
    ]
    rows = [(i, t, l, f"src{i % 3}" if i != 6 else None, len(t) if t is not None else None, "clash", 1.5, datetime.date(2024, 1, 1)) for i, t, l in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, __words date")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("false")

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score int, size string, target string, fingerprint string, order string, n_lines int, rep int, doc int"
WORDS = ["the", "Anat", "over", "lazy", "été", "größe", "niño", "fox", "Brown", "idiot", "run"]


def row(i, text, lang="en", source="s0"):
    return (i, text, lang, source, len(text or ""), "x", 7, "y", "z", "f", "o", 3, 1, 2)


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls, empty, blank and very long texts, repeated rows, ties, and columns whose names operators use."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choices(WORDS, k=n))
    rows = [row(i, say(rng.randint(1, 60)) + ".\n" + say(12), rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None])) for i in range(40)]
    rows += [row(100, None), row(101, ""), row(102, " \t\n"), row(103, say(9000)), row(104, "a" * 40_000), row(105, "\n".join(["same line as others here"] * 30)), row(None, say(20)), row(None, None, None, None)]
    rows += [rows[3], rows[3], rows[4], row(200, rows[5][1]), row(201, rows[5][1] + " more"), row(3, "another text under a used id")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

#: Extra columns whose names the operators use inside.
CLASHES = ("row", "n", "sid", "carry", "kept_id", "hit_id", "anchors", "key", "line_no", "bucket", "near", "ids")


def words(seed: int, n: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "her", "on", "wh", "st"], "fr": ["eau", "que", "é", "le", "oi", "ai"], "de": ["sch", "ung", "ü", "ein", "ß", "tz"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang): nulls, empties, ties, repeats, copies, near copies, very long texts."""
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = words(2, 70)
    long = "\n".join(words(100 + k, 40) for k in range(120))
    rows = [
        (1, base, "en"), (2, base, "en"), (3, " ".join(near), "en"), (4, None, "en"), (5, "", None), (6, "   \n \t", "fr"),
        (7, f"{words(3, 60)}\n{shared}\n{words(4, 50)}", "en"), (8, f"{words(5, 30)} x\n{shared}", None), (9, "12 34 !? 0", "de"),
        (10, long, "en"), (11, long + "\nend", "en"), (None, words(6, 50, "fr"), "fr"), (None, None, None), (12, "One two.", "en"),
        (13, "one  TWO.", "en"), (14, "a", "en"), (14, "a", "en"), (15, words(7, 80), "en"), (15, words(8, 80), "en"),
        (16, "ab" * 700, "en"), (17, "<|endoftext|> 　日本語 \x1c odd\r\n\r\nend", None), (18, "x" * 500, "en"), (18, "x" * 500, "en"),
        (-5, base, "en"), (19, words(9, 3000, "de"), "de"), (20, "\n\n\n", "en"), (22, "½ ² ①", "en"), (21, words(10, 64), "en"),
    ]
    rows += [(30 + k, words(50 + k, 60, ("en", "fr", "de")[k % 3]), ("en", "fr", "de")[k % 3]) for k in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string").repartition(3)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

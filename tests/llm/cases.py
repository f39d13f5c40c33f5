"""Small tables with the awkward rows every operator has to handle."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))


def awkward(spark, extra: str = ""):
    """Nulls in every column, empty and long texts, ties, repeated rows, a clashing column name."""
    long = prose(1, 4000)
    rows = [
        (1, prose(2, 60), "en", "a", 1),
        (2, prose(2, 60), "en", "a", 1),  # a copy
        (2, prose(2, 60), "en", "a", 1),  # a repeated row
        (3, None, "en", "a", None),
        (4, "", None, None, 0),
        (5, "   \n\t ", "de", "b", 6),
        (6, long, "de", "b", len(long)),
        (7, long + " tail", "de", "b", len(long)),
        (None, prose(3, 40), "fr", "b", 1),
        (None, None, None, None, None),
        (8, "?!", "fr", None, 2),
        (9, "one two", "fr", "b", 7),
        (10, "One two.", "fr", "b", 8),
        (11, prose(2, 60).upper(), None, "a", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        frame = frame.withColumn(extra, F.lit("clash"))
    return frame


def empty(spark):
    return spark.createDataFrame([], SCHEMA)

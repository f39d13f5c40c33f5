"""Clustering against plain Lloyd's rounds in whole Python numbers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridledger.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, settings):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == settings.dimensions and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(settings.scale * float(np.float32(x))) for x in v]))
    hashed = sorted(
        (hashlib.sha256(f"{settings.seed}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept
    )
    centres = [v for _, v in hashed[: settings.clusters]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(settings.rounds):
        own = assign()
        for k in range(len(centres)):
            members = [v for (c, _), (_, v) in zip(own, kept) if c == k]
            if members:
                centres[k] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    total = sum(d for _, d in own)
    return sorted(
        (
            -1 if i is None else i, c, d, sum(e for k, e in own if k == c), total,
            hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest(),
        )
        for (i, _), (c, d) in zip(kept, own)
    )


def collected(frame):
    return sorted((-1 if r[0] is None else r[0], *list(r)[1:]) for r in frame.collect())


def test_against_plain_rounds(spark):
    rng = np.random.default_rng(3)
    settings = centroids.Settings(clusters=7, dimensions=10, chunk=64, seed="x:")
    base = rng.normal(0, 0.2, (300, 10)).astype(np.float32)
    base[200:250] = base[200]  # a group of copies: ties, and dictionaries that pay
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [rows[5], (None, base[3].tolist()), (900, None), (901, []), (902, [None] + [0.1] * 9), (903, [float("nan")] * 10)]
    rows += [(904, [float("inf")] + [0.0] * 9), (905, [0.5] * 9), (906, [0.0] * 10), (907, [-1e-9] * 10)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit("clash")).repartition(5)
    assert collected(centroids.cluster(frame, settings)) == brute(rows, settings)


def test_few_vectors_and_none(spark):
    settings = centroids.Settings(dimensions=3)
    rows = [(1, [0.1, 0.2, 0.3]), (2, [0.4, 0.2, 0.1])]
    got = collected(centroids.cluster(spark.createDataFrame(rows, SCHEMA), settings))
    assert got == brute(rows, settings) and [r[2] for r in got] == [0, 0]
    assert centroids.cluster(spark.createDataFrame([], SCHEMA), settings).count() == 0


def test_numbers_are_held(spark):
    settings = centroids.Settings(dimensions=2)
    rows = [(1, [1e30, 0.0]), (2, [-1e30, 0.0])]
    got = centroids.cluster(spark.createDataFrame(rows, SCHEMA), settings).collect()
    assert [r["distance"] for r in got] == [0, 0]


@pytest.mark.parametrize("n, distinct", [(64, 2), (1000, 1000)])
def test_dictionaries_are_lossless(n, distinct):
    rng = np.random.default_rng(n)
    numbers = rng.integers(-50, 50, (distinct, 12))[rng.integers(0, distinct, n)]
    back = np.empty_like(numbers)
    widths = []
    for a, words, codes in centroids.dictionaries(numbers, 8):
        back[:, a : a + words.shape[1]] = words[codes]
        widths.append(words.shape[1])
    assert (back == numbers).all() and sum(widths) == 12
    assert max(widths) == (8 if distinct == 2 else 1)
    assert (centroids._wide(centroids._narrow(numbers)).reshape(n, 12) == numbers).all()

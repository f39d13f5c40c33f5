import numpy as np
import pytest
from pyspark.sql import functions as F

from gridledger.llm import mixing
from gridledger.llm.queries import MIXTURE
from tests.llm import cases


def plain_rake(table, targets, sweeps=500):
    """Raking of a dense numpy table."""
    weights = np.ones_like(table)
    for _ in range(sweeps):
        for axis, target in enumerate(targets):
            other = tuple(a for a in range(3) if a != axis)
            sums = (table * weights).sum(axis=other)
            shape = [1, 1, 1]
            shape[axis] = -1
            weights = weights * (target / sums).reshape(shape)
    return weights


def test_raking_against_numpy(spark):
    rng = np.random.default_rng(4)
    table = rng.integers(1, 1000, (4, 3, 2)).astype(float)
    table[1, 2, :] = 0  # an empty stretch
    names = [[f"{m}{i}" for i in range(n)] for m, n in zip("slt", table.shape)]
    cells = [
        (names[0][i], names[1][j], names[2][k], int(table[i, j, k]))
        for i in range(4) for j in range(3) for k in range(2)
    ]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    targets = {
        "source": dict(zip(names[0], (0.4, 0.3, 0.2, 0.1))),
        "lang": dict(zip(names[1], (0.5, 0.3, 0.2))),
        "topic": 0.5,
    }
    share = table.sum(axis=(0, 1)) / table.sum()
    wanted = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.sqrt(share) / np.sqrt(share).sum()]
    expected = plain_rake(table, wanted)
    got = mixing.rake(frame, mixing.Settings(targets, tolerance=1e-9, sweeps=60)).collect()
    assert len(got) == int((table > 0).sum())
    scale = None
    for r in got:
        i, j, k = names[0].index(r["source"]), names[1].index(r["lang"]), names[2].index(r["topic"])
        ratio = r["weight"] / expected[i, j, k]
        scale = scale or ratio
        assert ratio == pytest.approx(scale, rel=1e-6)


def test_probabilities_and_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    many = docs.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn(
        "doc_id", F.col("doc_id") * 100 + F.col("copy")
    ).drop("copy")
    rows = mixing.probabilities(many, MIXTURE).withColumn(
        "drawn", mixing.drawn(MIXTURE.seed, F.col("_mix_probability"))
    ).toPandas()
    p, tokens = rows["_mix_probability"], rows["_mix_tokens"]
    assert p.max() == pytest.approx(1) and p.min() >= 0
    expected = (tokens * p).groupby(rows["_mix_lang"]).sum() / (tokens * p).sum()
    for lang, share in MIXTURE.targets["lang"].items():
        assert expected[lang] == pytest.approx(share / sum(MIXTURE.targets["lang"][x] for x in expected.index), rel=1e-3)
    # The number drawn lies within five standard deviations of what is expected.
    spread = float((p * (1 - p)).sum()) ** 0.5
    assert abs(rows["drawn"].sum() - p.sum()) < 5 * spread
    assert sorted(r["doc_id"] for r in mixing.mix(many, MIXTURE).collect()) == sorted(rows.loc[rows["drawn"], "doc_id"])


def test_budget_scales_down(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    settings = mixing.Settings(MIXTURE.targets, budget=1000.0)
    rows = mixing.probabilities(docs, settings)
    assert rows.agg(F.sum(F.col("_mix_tokens") * F.col("_mix_probability"))).first()[0] == pytest.approx(1000, rel=1e-6)


def test_token_estimate(spark):
    texts = [None, "", "  ", "a", " a  b\nc ", "é\tü"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in frame.select(mixing.token_estimate()).collect()] == [len((t or "").split()) for t in texts]


def test_awkward_rows(spark):
    docs = cases.awkward(spark, "_mix_source")
    out = mixing.mix(docs, MIXTURE)
    assert out.columns == docs.columns
    assert out.count() <= 14
    assert mixing.mix(cases.empty(spark), MIXTURE).count() == 0
    same = mixing.mix(docs, MIXTURE)
    assert sorted(map(repr, same.collect())) == sorted(map(repr, out.collect()))

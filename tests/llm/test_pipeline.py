"""Each stage against a brute-force reading of its own input."""

import pytest

import corpus_pipeline
from gridledger.llm import decontam, jaccard, mixing, secrets, toxicity
from gridledger.llm.common import stored, table
from gridledger.llm.queries import MIXTURE
from tests.llm.test_jaccard import brute as brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir), "test-stage"))
    return out


def ids(frame):
    return sorted(r["doc_id"] for r in frame.select("doc_id").collect())


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "near-duplicates", "benchmark decontamination", "secrets", "mixture",
    ]
    assert all(s.columns == stages[0].columns and s.dtypes == stages[0].dtypes for s in stages)


def test_toxicity(spark, sf_dir, stages):
    model = toxicity.train(stages[0], table(spark, sf_dir, "labels").filter(~toxicity.held_out()))
    bad = {r["doc_id"] for r in toxicity.score(stages[0], model).filter("predicted = 1").collect()}
    assert bad and ids(stages[1]) == sorted(set(ids(stages[0])) - bad)


def test_near_duplicates(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert ids(stages[2]) == sorted({c for _, c, _ in brute_classes(rows)})


def test_leaks(spark, sf_dir, stages):
    models = decontam.models(stages[2], table(spark, sf_dir, "benchmark"))
    bad = {r["doc_id"] for r in decontam.search(stages[2], models).collect()}
    assert bad and ids(stages[3]) == sorted(set(ids(stages[2])) - bad)


def test_secrets(stages):
    assert ids(stages[4]) == ids(stages[3])
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for row in stages[4].collect():
        assert row["text"] == secrets.redacted(before[row["doc_id"]], "<secret>")
        assert not secrets.base_spans(row["text"]) and row["n_chars"] == len(row["text"])


def test_mixture(stages):
    odds = mixing.probabilities(stages[4], MIXTURE)
    p = odds["_mix_probability"]
    assert ids(stages[5]) == ids(odds.filter(mixing.drawn(MIXTURE.seed, p)))


def test_run(spark, sf_dir, stages):
    assert ids(corpus_pipeline.run(spark, sf_dir)) == ids(stages[5])
    assert jaccard.near_duplicates(stages[2]).filter("n_links > 0").count() == 0

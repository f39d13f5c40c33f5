"""The pruned nearest search gives the rows of the full one and scores fewer pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gridledger.operators import retrieval
from tests.test_retrieval import DOCS, QUESTIONS, dense


@pytest.mark.parametrize("k", [1, 3, 20])
def test_against_brute_force(spark, k):
    docs = spark.createDataFrame(DOCS, "id bigint, query string")
    questions = spark.createDataFrame(QUESTIONS, "question_id bigint, question string")
    got = retrieval.nearest_pruned(questions, docs, k).collect()
    assert {(r[0], r[1], r[2], round(r[3], 6)) for r in got} == dense(k)


def corpus(spark, n, seed=4):
    """Texts of common and rare words, with copies; questions made of the same words."""
    rnd = random.Random(seed)

    def text():
        # Frequencies as in prose: a word's share falls with its rank.
        return " ".join(f"word{int(rnd.paretovariate(0.6)) % 5000}" for _ in range(rnd.randrange(4, 25)))

    texts = [text() for _ in range(n)]
    texts += [rnd.choice(texts) for _ in range(n // 10)]
    docs = spark.createDataFrame([(i, f"the {t}") for i, t in enumerate(texts)], "id bigint, query string")
    asked = spark.createDataFrame([(i, f"the {text()}") for i in range(30)], "question_id bigint, question string")
    return docs, asked


def pairs(spark, docs, asked, k):
    counts = retrieval.term_counts(docs, "id", "query")
    idf = retrieval.inverse_frequencies(counts, docs, "query")
    vectors = retrieval._unit_vectors(counts, idf, "id")
    wanted = retrieval._unit_vectors(
        retrieval.term_counts(asked, "question_id", "question"), idf, "question_id"
    ).withColumnRenamed("weight", "asked_weight")
    postings, blocks = retrieval.posting_blocks(vectors, "id")
    chosen = retrieval.pruned_candidates(postings, blocks, wanted, k, "question_id", "id").count()
    every = vectors.join(wanted, "token").select("id", "question_id").distinct().count()
    return chosen, every


def test_same_rows_and_fewer_pairs(spark):
    docs, asked = corpus(spark, 1500)
    full = sorted(map(tuple, retrieval.nearest(asked, docs).collect()))
    assert sorted(map(tuple, retrieval.nearest_pruned(asked, docs).collect())) == full
    chosen, every = pairs(spark, docs, asked, 3)
    assert every == 30 * docs.count()  # one word is in all texts
    assert chosen < 0.8 * every


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_TEXTS", 50)
    docs, asked = corpus(spark, 800)
    full = sorted(map(tuple, retrieval.nearest(asked, docs).collect()))
    assert sorted(map(tuple, retrieval.nearest_pruned(asked, docs).collect())) == full
    vectors = retrieval.tfidf(docs)
    _, blocks = retrieval.posting_blocks(vectors, "id")
    assert blocks.agg(F.max("n")).first()[0] < 4 * 50
    assert blocks.filter("token = 'the'").count() > 10


def test_no_texts_or_questions(spark):
    docs, asked = corpus(spark, 20)
    assert retrieval.nearest_pruned(asked.limit(0), docs).count() == 0
    assert retrieval.nearest_pruned(asked, docs.limit(0)).count() == 0


def test_few_pairs_are_scored_and_asked_tokens_kept(spark, monkeypatch):
    docs, asked = corpus(spark, 1500)
    written = {}
    keep = retrieval._kept

    def counted(frame, name):
        out = keep(frame, name)
        written[name] = out
        return out

    monkeypatch.setattr(retrieval, "_kept", counted)
    retrieval.nearest_pruned(asked, docs)
    every = 30 * docs.count()
    assert written["pairs"].count() < 0.3 * every, (written["pairs"].count(), every)
    stray = written["vectors"].join(written["asked"], "token", "left_anti")
    assert written["vectors"].count() > 0 and stray.count() == 0

"""Nearest past questions against a dense brute-force computation."""

import math
import re
from collections import Counter

import pytest

from gridledger.operators import retrieval

DOCS = [
    (1, "volume of book GTUO in March"),
    (2, "Volume of book GTUO in march"),
    (3, "market value by segment"),
    (4, "!!! ?"),
    (5, ""),
    (6, None),
    (7, "Ünïcode wört und straße, volume"),
    (8, "a b c"),
    (9, "segment segment segment value"),
    (10, "completely unrelated words here"),
]
QUESTIONS = [
    (1, "volume of book"),
    (2, "segment value"),
    (3, "wört"),
    (4, "zzz yyy"),
    (5, "unrelated"),
    (6, "volume volume straße"),
]


def dense(k):
    docs = [(i, t) for i, t in DOCS if t]
    words = {i: Counter(re.findall(r"\w\w+", t.lower())) for i, t in docs}
    df = Counter(w for c in words.values() for w in c)
    idf = {w: math.log((1 + len(docs)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(counts):
        raw = {w: n * idf[w] for w, n in counts.items() if w in idf}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {w: v / norm for w, v in raw.items()} if norm else {}

    vectors = {i: unit(c) for i, c in words.items()}
    out = set()
    for q, text in QUESTIONS:
        v = unit(Counter(re.findall(r"\w\w+", text.lower())))
        if not v:
            continue
        scored = []
        for i, d in vectors.items():
            keys = set(v) | set(d)
            scored.append((round(sum((v.get(w, 0) - d.get(w, 0)) ** 2 for w in keys), 6), i))
        out |= {(q, r + 1, i, dist) for r, (dist, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 6, 20])
def test_nearest(spark, k):
    docs = spark.createDataFrame(DOCS, "id bigint, query string")
    questions = spark.createDataFrame(QUESTIONS, "question_id bigint, question string")
    got = retrieval.nearest(questions, docs, k).collect()
    assert {(r[0], r[1], r[2], round(r[3], 6)) for r in got} == dense(k)


def test_insights_filter_after_ranking(spark):
    logs = spark.createDataFrame(
        [
            (1, "volume of book", 1, None),
            (2, "volume of book A1", 0, "wrong unit"),
            (3, "volume of all books", 0, "  "),
            (4, "volume", 0, "too late"),
        ],
        "id bigint, query string, user_feedback int, feedback_comment string",
    )
    questions = spark.createDataFrame([(1, "volume of book")], "question_id bigint, question string")
    got = retrieval.feedback_insights(questions, logs, 2).collect()
    assert [r["insight"] for r in got] == ["Previous issue: volume of book A1 - wrong unit"]


def test_texts_meet_questions_in_place(spark):
    docs = spark.createDataFrame([(i, f"book {i} volume {i % 7}") for i in range(50)], "id bigint, query string")
    questions = spark.createDataFrame(QUESTIONS, "question_id bigint, question string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = retrieval.nearest(questions, docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Neither vectors nor scores are dealt by token or by pair.
    assert "Exchange hashpartitioning(token" not in plan
    assert "Exchange hashpartitioning(id#" in plan and "hashpartitioning(id, question_id" not in plan


def test_vectors_keep_frequent_counts_with_their_text(spark):
    rows = [(None, "red red one"), (None, "blue two"), (1, "red three"), (1, "red blue"), (2, "  "), (3, None)]
    rows += [(10 + i, f"red blue green w{i} w{i // 2}") for i in range(20)]
    docs = spark.createDataFrame(rows, "id long, query string")
    counts = retrieval.term_counts(docs, "id", "query")
    plain = retrieval._unit_vectors(counts, retrieval.inverse_frequencies(counts, docs, "query"), "id")
    wanted = sorted((str(r[0]), r[1], round(r[2], 9)) for r in plain.collect())
    for often in (0, 50, 10_000):  # no token, the frequent ones, all of them
        got = sorted((str(r[0]), r[1], round(r[2], 9)) for r in retrieval.tfidf(docs, often=often).collect())
        assert got == wanted
    # Counts of frequent tokens are not moved: nothing is dealt out by token but what they leave.
    plan = retrieval.tfidf(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan

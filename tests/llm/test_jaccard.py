import random
import re

import pytest
from pyspark.sql import functions as F

from gridledger.llm import jaccard
from gridledger.llm.components import components
from tests.llm import cases


def shingle_set(text, k=5):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, threshold=0.8):
    """Links of each row and the least id of its class, over all pairs of rows."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-12:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        out.append((doc_id, least.get(root(i)) if sets[i] else doc_id, links[i]))
    return sorted(out, key=repr)


def found(frame, settings=jaccard.Settings()):
    return sorted(
        ((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(frame, settings).collect()),
        key=repr,
    )


@pytest.mark.parametrize("block", [64, 3])
def test_groups_of_near_copies(spark, block):
    """Edited copies of a few texts, with blocks that hold all or only some of a group."""
    rnd = random.Random(5)
    rows = []
    for base in range(4):
        words = cases.prose(base, 80).split()
        for _ in range(14):
            copy = list(words)
            for _ in range(rnd.randrange(3)):
                copy[rnd.randrange(len(copy))] = "changed" + str(rnd.randrange(99))
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, cases.prose(100 + i, 50)) for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    settings = jaccard.Settings(block=block, group_block=max(4, block))
    assert found(frame, settings) == brute(rows)


def test_awkward_rows(spark):
    frame = cases.awkward(spark, "class_id")
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert found(frame) == brute(rows)
    assert jaccard.near_duplicates(cases.empty(spark)).count() == 0


def test_one_row_of_each_class_stays(spark):
    frame = cases.awkward(spark, "row_key")
    kept = jaccard.keep_one(frame)
    assert kept.columns == frame.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    # 1 stands for 2 and 11, 6 for 7, 9 for 10; rows without words stay.
    assert ids == sorted([1, 3, 4, 5, 6, None, None, 8, 9], key=repr)


def test_pruning_bound():
    least = jaccard.least_matches(jaccard.Settings())
    assert least == sorted(least) and len(least) == 6
    # A pair at the threshold is lost with a tiny probability only.
    from math import comb

    lost = sum(comb(16, m) * 0.8**m * 0.2 ** (16 - m) for m in range(least[0]))
    assert lost < 1e-5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 300), (300, 200), (None, 3)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["root"] for r in components(frame).collect()}
    want = {i: 0 for i in range(41)} | {i: 90 for i in (90, 95, 100)} | {200: 200, 300: 200}
    assert got == want
    assert components(frame.filter(F.lit(False))).count() == 0

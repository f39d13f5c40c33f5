"""Filter audit against every order applied row by row."""

import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from gridledger.llm import audit
from tests.llm import cases

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    """rows: (doc_id, text, lang); each order filters the rows one after the other."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)

    def fails(row, f):
        i, text, _ = row
        text = text or ""
        words = [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        return {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and first[text] < i,
        }[f]

    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [r for r in rows if (r[2] or "") == part]
        failed = [{f for f in "ABCDE" if fails(r, f)} for r in own]
        whole = Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(own)))
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failed[i]]
                left = [i for i in left if f not in failed[i]]
                whole[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left),
                    len(gone),
                    sum(f in x for x in failed) - len(gone),
                    sum(x == {f} for x in failed),
                    sum(own[i][0] in good for i in gone),
                    sum(own[i][0] in toxic for i in gone),
                    f,
                ]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = whole[value[-1]]
    return out


def collected(frame):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in frame.collect()}


def test_positional_popcounts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 14, 15, 16, 1000):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        wanted = [(words >> np.uint32(b) & np.uint32(1)).sum() for b in range(32)]
        assert audit.positional_popcounts(words).tolist() == wanted


def test_truth_words():
    table = audit.truth_words()
    for failed in range(32):
        for subset in range(32):
            assert bool(int(table[failed]) >> subset & 1) == (failed & subset == 0)


def test_against_every_order(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(120):
        n = rnd.choice([3, 99, 100, 140])
        words = [cases.prose(rnd.randrange(10**6), 1) if rnd.random() < 0.8 else "same" for _ in range(n)]
        text = rnd.choice([" ", "\t", "\x0b "]).join(words)
        if rnd.random() < 0.3:
            text = text.upper()
        if rnd.random() < 0.3:
            text += rnd.choice("#$%&*|")
        rows.append((i, text, rnd.choice(["en", "de", None, ""])))
    rows += [(1000 + j, rnd.choice(rows)[1], "en") for j in range(60)]  # copies
    rows += [rows[0], rows[-1], (None, rows[3][1], "en"), (None, None, None), (2000, None, "de"), (2001, "", "de"), (-1, " É", "x")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 1100, 2)]
    labels += [(0, 1, 1), (0, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collected(audit.audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == brute(rows, labels)


@pytest.mark.parametrize("extra", ["", "digest", "part"])
def test_awkward_rows(spark, extra):
    docs = cases.awkward(spark, extra)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    got = collected(audit.audit(docs, spark.createDataFrame([], LABELS)))
    assert got == brute(rows, [])


def test_empty(spark):
    assert audit.audit(cases.empty(spark), spark.createDataFrame([], LABELS)).count() == 0

import hashlib
from collections import Counter

import pytest

from gridledger.llm import suffixes
from tests.llm import cases


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, kept hash) of each text, window by window."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, covered) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(spark, texts, settings):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.removals(frame, settings).collect()}
    want = brute([(t or "").encode() for t in texts], settings.length)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id")
    want = same(spark, [r["text"] for r in docs.collect()], suffixes.Settings())
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("limit", [2000, 1])
def test_overlaps_repeats_and_borders(spark, limit):
    """A passage at many places with different surroundings, also through the path of large groups."""
    passage = cases.prose(7, 12)
    texts = [cases.prose(i, 6) + passage + cases.prose(50 + i, 6) for i in range(12)]
    texts += [passage, passage[3:], "é" * 90, "ab" * 60, "x" * 39, "x" * 40, "x" * 41, passage * 3, None, ""]
    texts += [passage[:60] + "!" + passage[60:], texts[0], texts[0]]
    want = same(spark, texts, suffixes.Settings(length=40, gram=8, group_limit=limit))
    assert sum(w[2] for w in want) > 20


def test_awkward_rows(spark):
    got = suffixes.removals(cases.awkward(spark, "n_spans")).collect()
    assert len(got) == 14
    assert [r["n_removed"] for r in got if r["n_bytes"] == 0] == [0, 0, 0]
    copies = [r for r in got if r["doc_id"] in (1, 2)]
    assert all(r["n_removed"] == r["n_bytes"] and r["kept"] == b"" for r in copies)
    assert suffixes.removals(cases.empty(spark)).count() == 0

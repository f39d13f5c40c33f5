import numpy as np
import pytest

from gridledger.llm import embeddings


def brute(ids, vectors, threshold=0.95):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        low = np.array([min([label[i], *label[near[i]]]) for i in range(len(x))])
        if (low == label).all():
            break
        label = low
    return {i: (int(near[k].sum()), ids[label[k]], ids[label[k]] == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block,searchers", [(1024, 8192), (16, 8)])
def test_recall_and_precision(spark, block, searchers):
    """Near copies at all angles around the threshold, and one large group."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((120, 24))
    vectors = list(centres)
    for c in centres[:60]:
        for size in (0.05, 0.2, 0.3, 0.4):
            vectors.append(c + size * np.linalg.norm(c) * rng.standard_normal(24) / np.sqrt(24))
    vectors += [centres[100] * (1 + 0.01 * i) + 0.01 * rng.standard_normal(24) for i in range(80)]
    vectors += [vectors[0]] * 5
    ids = list(range(len(vectors)))
    frame = spark.createDataFrame(
        [(i, [float(v) for v in x]) for i, x in zip(ids, vectors)], "vec_id long, embedding array<double>"
    )
    settings = embeddings.Settings(block=block, searchers=searchers, cell_members=16)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame, settings).collect()}
    want = brute(ids, vectors)
    # Nothing below the threshold, and nearly all above it.
    assert all(got[i][0] <= want[i][0] for i in ids)
    recall = sum(g[0] for g in got.values()) / sum(w[0] for w in want.values())
    assert recall >= 0.99
    if recall == 1:
        assert got == want


def test_awkward_rows(spark):
    one, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [
        (1, one, 0), (2, [2.0, 4.0, 6.0], 1), (2, [2.0, 4.0, 6.0], 1), (None, one, None),
        (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [nan, 1.0, 1.0], 0),
        (7, [inf, 1.0, 1.0], 0), (8, [], 0), (9, [1.0, 2.0], 0), (10, [1.0, 2.0], 0), (11, [5.0], 0),
        (12, [-1.0, -2.0, -3.0], 0), (13, [1e200, 2e200, 3e200], 0),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    got = embeddings.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[1] == (4, 1, True) and by[2] == (4, 1, False) and by[13] == (4, 1, False) and by[None] == (4, 1, False)
    assert by[9] == (1, 9, True) and by[10] == (1, 9, False)
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 11, 12))
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_recall_on_vectors_of_low_rank(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 8))
    near = [base + s * np.linalg.norm(base, axis=1, keepdims=True) * rng.standard_normal(base.shape) / 8**0.5 for s in (0.1, 0.2, 0.3)]
    vectors = np.concatenate([base, *near]) @ rng.standard_normal((8, 256))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(frame, embeddings.Settings(cell_members=24)).collect()}
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.98 * want.sum()

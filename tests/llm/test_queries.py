"""Registered queries: their SQL, the columns the contracts name, and one row per row."""

import pytest

import __spark_entry__ as entry
from gridledger.llm import queries
from tests import oracle

COLUMNS = {
    "op1_mixture": {"doc_id", "probability", "drawn"},
    "op2_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op3_near_duplicates": {"doc_id", "class_id", "n_links"},
    "op4_host_reputation": {"page_id", "host", "path", "rule", "verdict"},
    "op5_benchmark_leaks": {"doc_id", "item_id"},
    "op6_pseudonyms": {"doc_id", "text", "n_replaced"},
    "op7_repeated_bytes": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"},
    "op8_near_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op9_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op10_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op11_language_model": {
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
    },
    "op12_filter_audit": {
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    },
    "op13_centroids": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
}
TABLES = {"op4_host_reputation": "pages", "op8_near_vectors": "embeddings", "op13_centroids": "embeddings"}
OTHER_ROWS = ("op5_benchmark_leaks", "op12_filter_audit")  # only documents that hold an item; a report


def test_all_are_registered():
    assert set(COLUMNS) == set(queries.QUERIES)
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, sf_dir, name):
    frame = queries.QUERIES[name](spark, sf_dir).persist()
    assert COLUMNS[name] <= set(frame.columns)
    if name not in OTHER_ROWS:
        table = spark.read.parquet(f"{sf_dir}/{TABLES.get(name, 'documents')}.parquet")
        assert frame.count() == table.count()
    if name in queries.SQL:
        ok, note = oracle.compare(frame, oracle.connect(sf_dir), queries.SQL[name])
        assert ok, note
    frame.unpersist()

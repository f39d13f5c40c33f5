import os
import random

import pytest

from gridledger.llm import tokens
import public_tokenizers
from tests.llm import cases

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_agree_with_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = tokens.count_tokens(docs, PATH).collect()
    assert len(got) == len(texts)
    for row in got:
        ids = library.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["n_bytes"] == len(texts[row["doc_id"]].encode())
        assert row["over_limit"] == (len(ids) > 512)


def test_odd_characters_and_special_strings(library):
    rnd = random.Random(3)
    parts = ["aaaaaaaa", " ", "  ", "\n", "\x1c", "\x85", " ", "<|endoftext|>", "'s", "_", "½", "Ⅷ", "12"]
    texts = [
        "".join(
            rnd.choice([*parts, chr(rnd.randrange(32, 0x2FFF)), chr(rnd.randrange(0x10000, 0x1FBFF))])
            for _ in range(rnd.randrange(30))
        )
        for _ in range(1500)
    ]
    got = tokens.vocabulary(PATH).count(texts)
    assert got == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_full_cache_is_refilled(monkeypatch, library):
    monkeypatch.setattr(tokens, "CACHED", 50)
    own = tokens.Vocabulary(PATH)
    for seed in range(5):
        text = cases.prose(seed, 200)
        assert own.count([text, text]) == [len(library.encode(text).ids)] * 2


def test_awkward_rows(spark, library):
    got = tokens.count_tokens(cases.awkward(spark, "n_tokens"), PATH, limit=1).collect()
    assert len(got) == 14
    assert sorted(r["n_tokens"] for r in got if r["n_bytes"] == 0) == [0, 0, 0]
    assert [r["over_limit"] for r in got if r["doc_id"] == 9] == [True]
    assert tokens.count_tokens(cases.empty(spark), PATH).count() == 0

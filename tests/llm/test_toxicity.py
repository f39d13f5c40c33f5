import pickle
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from gridledger.llm import toxicity
from tests.llm import cases

BAD = ["vilegrot", "muckwort", "stinkbane", "foulmaw"]
SMALL = toxicity.Settings(max_labelled=400, dictionary_bytes=32_768, folds=2)


@pytest.fixture(scope="module")
def corpus(spark):
    """Ordinary prose, and as much with some words of a bad vocabulary; stems occur inside words."""
    rnd = random.Random(9)
    rows, labels = [], []
    for i in range(500):
        words = cases.prose(i, 60).split()
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD) + rnd.choice(["", "er", "s"]))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def model(corpus):
    docs, labels = corpus
    return toxicity.train(docs, labels.filter(~toxicity.held_out()), SMALL)


def test_held_out_accuracy(corpus, model):
    docs, labels = corpus
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60
    right = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    assert right >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_differences_are_compressed_lengths(model):
    scorer = model.scorer()
    for word in ("vilegrot", "alphabeta", "unheardof"):
        sizes = []
        for content in (model.ordinary, model.toxic):
            made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            settings = zstandard.ZstdCompressionParameters.from_level(
                model.level, source_size=64, dict_size=len(content), write_content_size=0,
                write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            )
            packer = zstandard.ZstdCompressor(dict_data=made, compression_params=settings)
            sizes.append(len(packer.compress(toxicity.window(word))))
        assert scorer.difference(word) == sizes[0] - sizes[1]
    assert scorer.difference("vilegrot") > 3 > scorer.difference("alphabeta")


def test_place_in_a_long_text_does_not_matter(model):
    quiet = cases.prose(1, 3000)
    loud = quiet + " " + " ".join(BAD * 3)
    assert model.score(loud) > 0.5 > model.score(quiet)


def test_training_is_repeatable(corpus, model):
    docs, labels = corpus
    again = toxicity.train(docs.repartition(5), labels.filter(~toxicity.held_out()).repartition(3), SMALL)
    assert again.toxic == model.toxic and again.ordinary == model.ordinary
    assert abs(again.score(BAD[0]) - model.score(BAD[0])) < 1e-9


def test_reject_keeps_rows_and_columns(spark, corpus, model):
    docs = cases.awkward(spark, "score").unionByName(
        spark.createDataFrame([(50, " ".join(BAD * 4), "en", "a", 1)], cases.SCHEMA).withColumn("score", F.lit("x"))
    )
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == 14
    assert kept.filter("doc_id = 50").count() == 0


def test_awkward_rows(spark, model):
    got = toxicity.score(cases.awkward(spark, "predicted"), model).collect()
    assert len(got) == 14
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4, 5, 8)}) == 1
    assert toxicity.score(cases.empty(spark), model).count() == 0
    docs = cases.awkward(spark)
    one_kind = spark.createDataFrame([(1, 0), (2, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, one_kind) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.reject(docs, None).count() == 14


def test_tasks_of_a_worker_share_what_was_compressed(model):
    """A model that reaches a worker twice, as with two tasks, compresses a word once."""
    first, second = (pickle.loads(pickle.dumps(model)) for _ in range(2))
    score = first.score("a wordseenonlyhere")
    assert "wordseenonlyhere" in second.scorer()
    assert second.score("a wordseenonlyhere") == score

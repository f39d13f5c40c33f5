import re

import numpy as np
import pytest

from gridledger.llm import decontam
from tests.llm import cases


def words(text):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = {(r["doc_id"], r["item_id"]): r for r in decontam.search(docs, decontam.models(docs, benchmark)).collect()}
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: words(r["text"]) for r in benchmark.collect()}
    return hits, texts, items


def test_all_verbatim_copies_are_found(found):
    hits, texts, items = found
    joined = {d: f" {' '.join(t)} " for d, t in texts.items()}
    want = {(d, i) for d, t in joined.items() for i, q in items.items() if f" {' '.join(q)} " in t}
    assert want and want <= set(hits)


def test_every_hit_holds_its_words(found):
    hits, texts, items = found
    for (doc, item), row in hits.items():
        share = longest_common(items[item], texts[doc]) / len(items[item])
        assert share >= row["sequence_share"] - 1e-9 and row["sequence_share"] >= 0.6


def test_bit_parallel_sequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 70)), rng.integers(0, 6, rng.integers(0, 90))
        masks = decontam.bit_masks(a)
        assert decontam.common_sequence(b, masks, len(a)) == longest_common(list(a), list(b))


def test_decomposition():
    """Leading directions of a matrix of fast decay."""
    rng = np.random.default_rng(2)
    left = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    matrix = left @ np.diag(10.0 ** -np.arange(60)) @ left.T
    probe = np.linalg.qr(rng.standard_normal((60, 20)))[0]
    space = decontam.nystrom(probe, matrix @ probe, 5)
    assert np.allclose(np.abs((space * left[:, :5]).sum(0)), 1, atol=1e-3)


def test_paraphrases_and_answers(spark):
    item = cases.prose(900, 40) + ". " + "seven purple mountains rise"
    kept = item.split()
    changed = [("other" + w if i % 5 == 4 and i < 38 else w) for i, w in enumerate(kept)]
    rows = [(i, cases.prose(i, 150)) for i in range(60)]
    rows += [
        (100, cases.prose(70, 80) + " " + item + " " + cases.prose(71, 80)),
        (101, cases.prose(72, 80) + " " + " ".join(changed) + " " + cases.prose(73, 80)),
        (102, cases.prose(74, 80) + " " + " ".join(kept[:18]) + " " + cases.prose(75, 80)),
        (103, cases.prose(76, 500) + " " + item.upper().replace(" ", "\n")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(5, item), (6, None), (7, ""), (5, item)], "item_id long, text string")
    models = decontam.models(docs, benchmark)
    assert {r["doc_id"] for r in decontam.search(docs, models).collect()} == {100, 101, 103}
    assert {r["doc_id"] for r in decontam.clean(docs, models).collect()} == set(range(60)) | {102}
    # With an answer that stands nowhere, the paraphrase does not count; the copies do.
    asked = spark.createDataFrame([(5, item, "nowhere to be found")], "item_id long, text string, answer string")
    hits = decontam.search(docs, decontam.models(docs, asked)).collect()
    assert {r["doc_id"] for r in hits} == {100, 101, 103} - ({101} if _share(changed, kept) < 0.75 else set())


def _share(changed, kept):
    return longest_common([words(w)[0] for w in kept], [words(w)[0] for w in changed]) / len(kept)


def test_many_items_in_blocks(spark):
    rows = [(i, cases.prose(i, 60)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, cases.prose(i, 60)) for i in range(0, 40, 2)], "item_id long, text string")
    models = decontam.models(docs, benchmark, decontam.Settings(block_items=7))
    assert len(models) > 1
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.search(docs, models).collect()) == [(i, i) for i in range(0, 40, 2)]


def test_awkward_rows(spark):
    docs = cases.awkward(spark, "item_id")
    benchmark = spark.createDataFrame([(1, cases.prose(3, 40)), (None, "one two"), (2, None)], "item_id long, text string")
    models = decontam.models(docs, benchmark)
    hits = {(r["doc_id"], r["item_id"]) for r in decontam.search(docs, models).collect()}
    assert hits == {(None, 1), (9, None), (10, None)}
    left = decontam.clean(docs, models)
    assert left.columns == docs.columns and left.count() == 11
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.models(docs, none) == []
    assert decontam.clean(docs, []).count() == 14
    assert decontam.search(cases.empty(spark), decontam.models(cases.empty(spark), benchmark)).count() == 0


def test_paraphrase_found_by_the_corpus_directions_only(spark):
    """Rare words replaced by their companions of other documents: no weighted term is shared."""
    common, ours, theirs = ([f"{k}{i}" for i in range(n)] for k, n in (("common", 42), ("ours", 18), ("theirs", 36)))
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.permutation(common)) + " " + cases.prose(i, 60)) for i in range(200)]
    rows += [(200 + i, " ".join(rng.permutation(ours + theirs))) for i in range(15)]
    item = [w for i in range(18) for w in (common[2 * i], ours[i], common[2 * i + 1])] + common[36:]
    asked = " ".join(item[:-6]) + ". " + " ".join(item[-6:])
    changed = [w for i, c in enumerate(common) for w in (c, *theirs[2 * (i % 18) : 2 * (i % 18) + 2], theirs[(7 * i) % 36])]
    rows.append((300, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, asked), (2, " ".join(theirs))], "item_id long, text string")
    hits = {n: {(r["doc_id"], r["item_id"]): r["cosine"] for r in decontam.search(docs, decontam.models(docs, benchmark, decontam.Settings(rank=n))).collect()} for n in (0, 1)}
    assert (300, 1) not in hits[0] and hits[1][300, 1] == 0
    assert (0, 1) not in hits[1]


def test_copies_are_found_whatever_the_words_weigh(spark):
    common = [f"common{i}" for i in range(18)]
    rows = [(i, " ".join(common[::-1]) + " " + cases.prose(i, 60)) for i in range(40)]
    rows.append((100, cases.prose(50, 80) + " " + " ".join(common) + " " + cases.prose(51, 80)))
    rare = cases.prose(900, 64)
    rows.append((101, cases.prose(52, 80) + " " + rare + " " + cases.prose(53, 80)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(common)), (2, rare)], "item_id long, text string")
    models = decontam.models(docs, items)
    # All words of the first item stand in most documents and weigh nothing.
    assert {(r["doc_id"], r["item_id"]) for r in decontam.search(docs, models).collect()} == {(100, 1), (101, 2)}
    # In a huge corpus the words around an item outweigh it.
    finder = decontam.Finder(models[0])
    finder.model.top_idf *= 1000
    for shift in range(40):
        text = cases.prose(54, 60 + shift) + " " + rare + " " + cases.prose(55, 80)
        assert [hit[:2] for hit in finder.find([text.lower().encode()])] == [(0, 2)]


def test_passages_are_multiplied_together():
    """Rows times a table, few calls for many passages, some without any known word."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(vocabulary, n)).encode() for n in rng.integers(0, 300, 80)] + [b"else where", b""]
    terms = np.unique(np.concatenate([decontam._hashes(" ".join(vocabulary[:40]))]))
    model = decontam.Model(decontam.Settings(), terms, [], rng.random(len(terms)) + 0.1)
    rows = decontam.Passages(texts, model)
    dense = np.zeros((int(rows.first[-1]), len(terms)))
    dense[rows.passage, rows.term] = rows.value
    table = Counted.of(rng.standard_normal((len(terms), 7)))
    wanted = rng.permutation(len(dense))
    assert np.allclose(rows.project(table, np.sort(wanted)), dense[np.sort(wanted)] @ np.asarray(table))
    assert Counted.calls < len(dense) / 2
    lengths = np.sqrt((dense**2).sum(1))
    assert np.allclose(lengths, rows.share)


class Counted(np.ndarray):
    """A table that counts how often rows are taken from it."""

    calls = 0

    @classmethod
    def of(cls, values):
        return values.view(cls)

    def take(self, *args, **kwargs):
        Counted.calls += 1
        return np.asarray(self).take(*args, **kwargs)

    def __getitem__(self, at):
        Counted.calls += 1
        return np.asarray(self)[at]

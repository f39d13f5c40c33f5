"""Toxicity by compression distance: one zstandard dictionary of toxic and one of ordinary text.

A text is cut into windows; each window is compressed under both dictionaries, and the difference
of the two lengths tells which language it is closer to. A window is one word, written as a code of
a few bytes per input byte: a known stem is then one long match, an unknown one many literals, so
that single words resolve well in whole bytes of output. The windows of a text above a ladder of
thresholds are counted, and a logistic model calibrated on labelled texts turns the counts into a
score.

Training. A bounded sample of labelled texts (`max_labelled` per label, chosen by hash) gives the
document frequencies of words under each label. The toxic dictionary holds the words that toxic texts
favour, the ordinary dictionary the most frequent others, both up to a size. Counts that calibrate the
model come from dictionaries of other folds, so that the model sees words as unseen texts have
them; the final dictionaries use all folds. Frequencies and features are computed by Spark; the
driver holds dictionaries and one row of features per sampled text.

Defined results: null, empty and wordless texts get the score of a text without any evidence;
repeated rows are scored each; null labels, and labels of no document, are not learned from; without labelled
texts of both kinds every score is the base rate of 0. Labels, lang, source and doc_id are never
inputs of a score. Additional columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import in_small_batches, map_arrow, mix64, stored, strings

WORD = re.compile(r"[^\W_]+")
CODE = 4  # output bytes per input byte of a window
LADDER = (1, 3, 6, 9, 12, 16)  # thresholds on the difference of lengths
CACHED = 600_000  # windows whose differences a worker remembers
MAX_WORD = 64  # characters of a window; a longer word is cut into several


@dataclass(frozen=True)
class Settings:
    max_labelled: int = 3000  # sampled training texts per label
    dictionary_bytes: int = 131_072  # size of each dictionary, coded
    level: int = 19
    folds: int = 3
    seed: int = 7


def codes() -> list[bytes]:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return [int(v).to_bytes(8, "little")[:CODE] for v in values]


CODES = codes()


def window(word: str) -> bytes:
    """A word with its ends marked, coded."""
    return b"".join(map(CODES.__getitem__, f"^{word}$".encode()))


def words(text: str) -> list[str]:
    """The windows of a text: its lower-cased words."""
    found = WORD.findall(text.lower())
    if found and len(max(found, key=len)) > MAX_WORD:
        found = [w[i : i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]
    return found


class Scorer(dict):
    """Differences of compressed lengths under an ordinary and a toxic dictionary, by word.

    A known word is looked up as in any dict, without a call of Python code; `__missing__` compresses.
    """

    def __init__(self, toxic: bytes, ordinary: bytes, level: int):
        super().__init__()
        self.pair = [self._compressor(d, level) for d in (ordinary, toxic)]

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        made = zstandard.ZstdCompressionDict(
            content or bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        settings = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=64, dict_size=len(content), write_content_size=0,
            write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        return zstandard.ZstdCompressor(dict_data=made, compression_params=settings)

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED:
            self.clear()
        coded = window(word)
        ordinary, toxic = (len(c.compress(coded)) for c in self.pair)
        value = self[word] = ordinary - toxic
        return value

    def difference(self, word: str) -> int:
        return self[word]

    def features(self, text: str) -> list[float]:
        found = words(text)
        gains = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        n = max(1, len(found))
        row = []
        for step in LADDER:
            above = int((gains >= step).sum())
            row += [math.log1p(above), above / math.sqrt(n), above / n]
        # Length alone is no evidence: it only scales counts.
        return [*row, float(max(0, gains.max(initial=0)))]


@lru_cache(maxsize=2)
def scorer_of(toxic: bytes, ordinary: bytes, level: int) -> Scorer:
    """The scorer of two dictionaries; the tasks of a worker share it and what it has met."""
    return Scorer(toxic, ordinary, level)


def logistic(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: centre, scale, weights (the last is constant)."""
    centre, scale = rows.mean(0), rows.std(0)
    scale[scale < 1e-6] = 1.0  # a feature that never varied gets no weight
    x = np.c_[(rows - centre) / scale, np.ones(len(rows))]
    weights = np.zeros(x.shape[1])
    ridge = np.eye(len(weights))
    ridge[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        weights += np.linalg.solve(curve, x.T @ (labels - p) - ridge @ weights)
    return centre, scale, weights


@dataclass
class Model:
    """Dictionaries and calibration; the compressors are made where they are used."""

    toxic: bytes
    ordinary: bytes
    level: int
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return scorer_of(self.toxic, self.ordinary, self.level)

    def score(self, text: str) -> float:
        row = (np.array(self.scorer().features(text)) - self.centre) / self.scale
        return float(1 / (1 + np.exp(-np.clip(row @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _content(ranked: list[str], size: int) -> bytes:
    """Dictionary content; the best words stand last, where references are shortest."""
    out, total = [], 0
    for word in ranked:
        coded = window(word)
        if total + len(coded) > size:
            break
        out.append(coded)
        total += len(coded)
    return b"".join(reversed(out))


def _dictionaries(counts: DataFrame, fold: int | None, settings: Settings, n: dict) -> tuple[bytes, bytes]:
    """Toxic and ordinary dictionary of all folds but one. `counts`: word, toxic, fold, n_docs."""
    rest = counts if fold is None else counts.filter(F.col("fold") != fold)
    toxic = sum(v for (y, f), v in n.items() if y == 1 and f != fold)
    plain = sum(v for (y, f), v in n.items() if y == 0 and f != fold)
    both = rest.groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n_docs")).otherwise(0)).alias("t"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n_docs")).otherwise(0)).alias("o"),
    )
    odds = ((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("o") + 0.5) / (plain + 1))
    both = both.withColumn("odds", odds)
    # A coded word has at least CODE * 3 bytes, which bounds the rows that can be used.
    most = settings.dictionary_bytes // (CODE * 3) + 1
    favoured = both.filter("t >= 3 AND odds >= 6").orderBy(
        (F.col("t") * F.log("odds")).desc(), "word"
    )
    common = both.filter("o >= 1 AND odds < 2").orderBy(F.col("o").desc(), "word")
    return tuple(
        _content([r["word"] for r in x.select("word").limit(most).collect()], settings.dictionary_bytes)
        for x in (favoured, common)
    )


def sample(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """A bounded sample of labelled texts: toxic, fold, text.

    The ids are drawn from the label table, `max_labelled` of each label by hash, before any text
    is read; a doc_id with several labels is toxic if one of them says so.
    """
    drawn = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    order = F.xxhash64(F.lit(settings.seed), "doc_id")
    best = drawn.withColumn("_order", order)
    halves = [
        best.filter(F.col("toxic") == y).orderBy("_order", "doc_id").limit(settings.max_labelled)
        for y in (0, 1)
    ]
    ids = halves[0].unionByName(halves[1]).withColumn(
        "fold", F.pmod(F.xxhash64(F.lit(settings.seed + 1), "doc_id"), F.lit(settings.folds)).cast("int")
    )
    # At most 2 * max_labelled ids, so sending them to every task is safe.
    return (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", "text")
        .join(F.broadcast(ids), "doc_id")
        .select("toxic", "fold", F.coalesce("text", F.lit("")).alias("text"))
    )


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Dictionaries and calibration from labelled texts; None without texts of both kinds."""
    chosen = stored(sample(docs, labels, settings), "toxicity-sample")

    def vocabulary(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, i) for i, t in enumerate(strings(batch.column(2))) for w in set(words(t))]
        at = pa.array([i for _, i in rows], pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in rows], pa.string()), batch.column(0).take(at), batch.column(1).take(at)],
            ["word", "toxic", "fold"],
        )

    n = {(r["toxic"], r["fold"]): r["count"] for r in chosen.groupBy("toxic", "fold").count().collect()}
    if not all(any(y == k for k, _ in n) for y in (0, 1)):
        return None
    counts = stored(
        map_arrow(chosen.select("toxic", "fold", "text"), vocabulary, "word string, toxic int, fold int")
        .groupBy("word", "toxic", "fold")
        .agg(F.count(F.lit(1)).alias("n_docs")),
        "toxicity-words",
    )
    parts = {f: _dictionaries(counts, f, settings, n) for f in range(settings.folds)}
    level = settings.level
    scorers: dict[int, Scorer] = {}

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for fold, text in zip(batch.column(1).to_pylist(), strings(batch.column(2))):
            if fold not in scorers:
                scorers[fold] = Scorer(*parts[fold], level)
            rows.append(scorers[fold].features(text))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "features"]
        )

    seen = map_arrow(
        chosen.select("toxic", "fold", "text").repartition(4 * settings.folds, "fold", F.xxhash64("text")),
        features,
        "toxic int, features array<double>",
    ).collect()
    fit = logistic(np.array([r["features"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    return Model(*_dictionaries(counts, None, settings, n), level, *fit)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of every row's whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [0.0 if model is None else model.score(t) for t in strings(batch.column(2))]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(found, pa.float64()),
                pa.array([int(s >= 0.5) for s in found], pa.int32()),
            ],
            ["doc_id", "held_out", "score", "predicted"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", held_out().alias("held_out"), "text"),
        work,
        f"doc_id {kind}, held_out boolean, score double, predicted int",
    )


def reject(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    if model is None:
        return docs

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch.column(batch.schema.get_field_index("text")))
        keep = pa.array([model.score(t) < threshold for t in texts], pa.bool_())
        return batch.filter(keep)

    return in_small_batches(docs).mapInArrow(lambda batches: map(work, batches), docs.schema)

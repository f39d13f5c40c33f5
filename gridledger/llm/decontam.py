"""Benchmark decontamination by latent semantic retrieval, with sequence and answer checks.

Documents are cut into passages of 64 words that overlap by half. A passage is a TF-IDF vector over the
benchmark's terms; terms of more than a tenth of all documents weigh nothing, and words that the
benchmark lacks add to a passage's length only. A randomised SVD of all passages gives the latent
directions of the corpus: one distributed pass computes Z = A'A O for a random O, and the Nystrom form
of the decomposition follows from Z alone. Another pass compares all passages with all benchmark
passages. A passage with the half window after it that holds as many of an item's words as the sequence
check needs is a candidate, whatever the words weigh, however large the corpus and whatever stands around:
no match within a window is lost. Beyond that, a candidate is near by the TF-IDF cosine, or near by the cosine within the latent space alone
(the query folded in, both sides normalised there) while it holds half of the words that the sequence
check needs. Candidates are checked on the words: the longest common subsequence with the neighbourhood of the passage,
and the share of the answer found there in order (column `answer`; without it, the last sentence). A
nearly verbatim copy needs the sequence only, a paraphrase needs both.

The benchmark is the stated query set, taken in blocks of `block_items`; a block's model is small and goes
to every task. Document frequencies, the decomposition and the search cover all documents. Sums over
the corpus are added up by block of terms on the executors.

Words are longest runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
Defined results: null, empty and wordless documents and items match nothing; repeated rows are judged
each; an item of several passages counts as found when half of its words lie in found passages; items of
under eight words must be found whole. An empty benchmark leaves all documents. Additional columns stay
as they are in `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import (
    Words,
    in_small_batches,
    lowered,
    map_arrow,
    pieces,
    strings,
)


@dataclass(frozen=True)
class Settings:
    window: int = 64  # words of a passage; the next begins half a window later
    common: float = 0.1  # terms in a larger share of documents weigh nothing
    rank: int = 32  # latent directions of the corpus
    oversampling: int = 8
    block_items: int = 256  # benchmark passages per model
    cosine: float = 0.2  # candidates
    latent: float = 0.7  # candidates within the latent space
    verbatim: float = 0.75  # share of an item's words in common sequence
    paraphrase: float = 0.6  # the same, if the answer is there too
    answer: float = 0.8
    short: int = 8  # items of fewer words must be found whole
    seed: int = 11


@dataclass
class Model:
    """Terms, weights, latent space and query passages of one block of the benchmark."""

    settings: Settings
    terms: np.ndarray  # sorted hashes of the benchmark's words
    queries: list[tuple]  # item_id, words of the item, word hashes, answer hashes
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    top_idf: float = 1.0
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # query passages by term
    space: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    latent: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


def _hashes(text: str) -> np.ndarray:
    return Words(lowered([text])).hash


def queries(rows: list, settings: Settings) -> list[tuple]:
    """Passages of benchmark items: (item_id, words in the item, word hashes, answer hashes)."""
    out = []
    for item_id, text, answer in rows:
        found = _hashes(text or "")
        if not len(found):
            continue
        if answer:
            tail = _hashes(answer)
        else:
            sentences = [s for s in re.split(r"[.!?]+", text) if s.strip()]
            tail = _hashes(sentences[-1]) if sentences else found
            tail = found[-max(5, len(tail)) :]
        for a in range(0, len(found), settings.window):
            part = found[a : a + settings.window]
            last = a + settings.window >= len(found)
            out.append((item_id, len(found), part, tail if last or answer else part[:0]))
    return out


TAKEN = 1 << 16  # values taken from a table at once


class Passages:
    """Sparse TF-IDF rows of the passages of some texts, for a model."""

    def __init__(self, texts: list[bytes], model: Model):
        half = model.settings.window // 2
        self.words = words = Words(texts)
        at = np.minimum(np.searchsorted(model.terms, words.hash), len(model.terms) - 1)
        known = model.terms[at] == words.hash
        self.at = np.where(known, at, len(model.terms))  # term of each word, or one past the last
        weight = np.where(known, model.idf[at], model.top_idf)
        n = np.diff(words.first)
        count = np.maximum(1, -(-n // half) - 1)  # passages of each text
        count[n == 0] = 0
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.text = np.repeat(np.arange(len(texts)), count)
        place = (np.arange(len(words.hash)) - words.first[words.text]) // half
        last = count[words.text] - 1
        # Each word lies in the passage that begins in its half window and in the one before.
        later = np.minimum(place, last)
        earlier = place - 1
        again = (earlier >= 0) & (earlier < later)
        base = self.first[words.text]
        passage = np.concatenate((base + later, (base + earlier)[again]))
        term = np.concatenate((np.where(known, at, -1), np.where(known, at, -1)[again]))
        weight = np.concatenate((weight, weight[again]))
        outside = term < 0
        length2 = np.bincount(passage[outside], weight[outside] ** 2, minlength=int(self.first[-1]))
        # Repeated terms of a passage add up.
        key = np.sort(passage[~outside] * np.int64(len(model.terms)) + term[~outside])
        edge = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(edge, append=len(key))
        key = key[edge]
        value = model.idf[key % len(model.terms)] * times
        self.held, self.n_terms = key, len(model.terms)
        key, value = key[value > 0], value[value > 0]
        self.passage, self.term = key // len(model.terms), key % len(model.terms)
        inside2 = np.bincount(self.passage, value**2, minlength=len(length2))
        length = np.sqrt(length2 + inside2)
        self.value = value / np.maximum(length[self.passage], 1e-12)
        self.share = np.sqrt(inside2) / np.maximum(length, 1e-12)

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Terms of each passage and of the half window after it, whatever they weigh: (passage, term)."""
        passage = self.held // self.n_terms
        later = passage > self.first[self.text[passage]]
        key = np.sort(np.concatenate((self.held, self.held[later] - self.n_terms)))
        key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        return key // self.n_terms, key % self.n_terms

    def project(self, space: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Rows of the wanted passages times `space`."""
        out = np.zeros((len(wanted), space.shape[1]), space.dtype)
        first = np.searchsorted(self.passage, wanted)
        size = np.searchsorted(self.passage, wanted, side="right") - first
        # Passages of as many terms are multiplied together, in slices that bound the rows taken from `space`.
        order = np.argsort(size, kind="stable")
        ends = np.flatnonzero(np.diff(size[order], append=-1)) + 1
        begin = int((size == 0).sum())
        for end in ends[ends > begin].tolist():
            n = int(size[order[begin]])
            step = max(1, TAKEN // (n * max(1, space.shape[1])))
            for a in range(begin, end, step):
                some = order[a : min(a + step, end)]
                at = first[some][:, None] + np.arange(n)
                value = self.value[at].astype(space.dtype)
                out[some] = np.matmul(value[:, None, :], space.take(self.term[at], axis=0))[:, 0]
            begin = end
        return out


def row_sums(row: np.ndarray, term: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """Sums of the table's rows over the terms of each of n rows; `row` is sorted."""
    size = np.bincount(row, minlength=n)
    order = np.argsort(-size, kind="stable")
    starts = (np.cumsum(size) - size)[order]
    sums = np.zeros((n, table.shape[1]), table.dtype)
    for j in range(int(size.max(initial=0))):
        active = int((size > j).sum())
        sums[:active] += table[term[starts[:active] + j]]
    out = np.empty_like(sums)
    out[order] = sums
    return out


def _each_text(frame: DataFrame, per_partition, schema: str) -> DataFrame:
    """Run over all texts of a partition; `per_partition` gets an iterator of lists of bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[list[bytes]]:
            for batch in batches:
                found = lowered(strings(batch.column(0)))
                for a, b in pieces(found):
                    yield found[a:b]

        yield from per_partition(texts())

    return in_small_batches(frame.select("text")).mapInArrow(run, schema)


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of documents that hold each term, and of all documents."""

    def count(texts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for part in texts:
            n += len(part)
            words = Words(part)
            at = np.minimum(np.searchsorted(terms, words.hash), len(terms) - 1)
            known = terms[at] == words.hash
            pairs = np.unique(words.text[known] * np.int64(len(terms)) + at[known])
            total += np.bincount(pairs % len(terms), minlength=len(terms))
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(has, -1).astype(np.int32)), pa.array(np.append(total[has], n))], ["term", "n"]
        )

    found = _each_text(docs, count, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(len(terms), np.int64), 0
    for term, value in found:
        if term < 0:
            n = value
        else:
            df[term] = value
    return df, n


TERM_BLOCK = 256


def corpus_sketch(docs: DataFrame, model: Model, probe: np.ndarray) -> tuple[np.ndarray, int]:
    """A'A times `probe` over all passages, and the number of passages."""
    width = probe.shape[1]

    def sketch(texts: Iterator[list[bytes]]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(probe.shape, np.float64), 0
        for part in texts:
            rows = Passages(part, model)
            n += int(rows.first[-1])
            if not len(rows.term):
                continue
            starts = np.flatnonzero(np.concatenate(([True], rows.passage[1:] != rows.passage[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(rows.term)])))
            # Slices of passages bound the dense rows.
            for a in range(0, len(starts), 2048):
                size = sizes[a : a + 2048]
                span = slice(starts[a], starts[a] + int(size.sum()))
                value = rows.value[span].astype(np.float32)[:, None]
                term = rows.term[span]
                image = np.add.reduceat(value * probe[term], starts[a : a + 2048] - starts[a])
                back = value * np.repeat(image, size, axis=0)
                order = np.argsort(term, kind="stable")
                which = term[order]
                cut = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
                total[which[cut]] += np.add.reduceat(back[order], cut)
        blocks = range(0, len(total), TERM_BLOCK)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(range(len(blocks))), pa.int32()),
                pa.array([total[b : b + TERM_BLOCK].astype(np.float32).tobytes() for b in blocks], pa.binary()),
                pa.array([n if b == 0 else 0 for b in blocks], pa.int64()),
            ],
            ["block", "sums", "n"],
        )

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for block, sums, n in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(sums, np.float32)
                old = held.get(block)
                held[block] = (values.astype(np.float64), n) if old is None else (old[0] + values, old[1] + n)
        for block, (values, n) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([values.tobytes()], pa.binary()), pa.array([n], pa.int64())],
                ["block", "sums", "n"],
            )

    schema = "block int, sums binary, n bigint"
    parts = _each_text(docs, sketch, schema).repartition("block").mapInArrow(add, schema).collect()
    out, n = np.zeros(probe.shape), 0
    for block, sums, count in parts:
        values = np.frombuffer(sums, np.float64).reshape(-1, width)
        out[block * TERM_BLOCK : block * TERM_BLOCK + len(values)] += values
        n += count
    return out, n


def train(docs: DataFrame, rows: list, settings: Settings = Settings()) -> Model | None:
    """The model of one block of benchmark items (item_id, text, answer); None without words."""
    asked = queries(rows, settings)
    if not asked:
        return None
    model = Model(settings, np.unique(np.concatenate([q[2] for q in asked])), asked)
    df, n_docs = document_frequencies(docs, model.terms)
    model.top_idf = float(np.log(n_docs + 1)) or 1.0
    model.idf = np.where(df > settings.common * n_docs, 0.0, np.log((n_docs + 1) / (df + 1)))
    if not model.idf.any():  # so few documents that every term is common
        model.idf[:] = 1.0
    own = np.zeros((len(asked), len(model.terms)))
    for i, (_, _, words, _) in enumerate(asked):
        np.add.at(own[i], np.searchsorted(model.terms, words), 1.0)
    own *= model.idf
    own /= np.maximum(np.sqrt((own**2).sum(1, keepdims=True)), 1e-12)
    width = min(len(model.terms), settings.rank + settings.oversampling)
    probe = np.linalg.qr(np.random.default_rng(settings.seed).standard_normal((len(model.terms), width)))[0]
    image, n = corpus_sketch(docs, model, probe.astype(np.float32))
    corpus = nystrom(probe, image, settings.rank) if n and image.any() else probe[:, :0]
    model.own, model.space = own.astype(np.float32), corpus.astype(np.float32)
    latent = own @ corpus
    model.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return model


def nystrom(probe: np.ndarray, image: np.ndarray, rank: int) -> np.ndarray:
    """Leading eigenvectors of a positive matrix M from image = M @ probe."""
    shift = 1e-9 * np.linalg.norm(image)
    image = image + shift * probe
    core = probe.T @ image
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-12 * values.max()
    half = image @ (vectors[:, good] / np.sqrt(values[good]))
    left, size, _ = np.linalg.svd(half, full_matrices=False)
    # Sums come in single precision: what is smaller than this is noise and no direction.
    return left[:, size**2 > 1e-6 * size[0] ** 2][:, :rank]


def common_sequence(words: np.ndarray, masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence with a query of n words, given as bit masks."""
    every = (1 << n) - 1
    row = every
    for word in words.tolist():
        mask = masks.get(word)
        if mask:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & every
    return n - row.bit_count()


def bit_masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(words.tolist()):
        masks[word] = masks.get(word, 0) | (1 << i)
    return masks


class Finder:
    """Finds benchmark items in texts."""

    def __init__(self, model: Model):
        self.model = model
        self.masks = [(bit_masks(q[2]), bit_masks(q[3])) for q in model.queries]
        self.own = np.ascontiguousarray(model.own.T)
        settings = model.settings
        # How often each query has a term, and of how many words the sequence check needs to meet.
        kind = np.uint8 if settings.window < 256 else np.uint32
        self.times = np.zeros((len(model.terms), len(model.queries)), kind)
        self.need = np.zeros(len(model.queries), kind)
        for q, (_, n_words, words, _) in enumerate(model.queries):
            np.add.at(self.times[:, q], np.searchsorted(model.terms, words), 1)
            share = 1.0 if n_words < settings.short else min(settings.verbatim, settings.paraphrase)
            self.need[q] = int(np.ceil(share * len(words) - 1e-9))
        self.asked = [np.unique(np.searchsorted(model.terms, q[2]), return_counts=True) for q in model.queries]
        self.met = np.zeros(len(model.terms) + 1, bool)

    def find(self, texts: list[bytes]) -> list[tuple[int, object, float, float, float]]:
        """(text index, item_id, best cosine, share of common sequence, share of the answer)."""
        model, settings = self.model, self.model.settings
        rows = Passages(texts, model)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for passage, q, cosine in self.candidates(rows):
            score = self._check(rows, passage, q, cosine)
            if score is None:
                continue
            key = (int(rows.text[passage]), q)
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), score)
        items: dict[tuple[int, object], list[float]] = {}
        for (text, q), (sequence, answer, cosine) in best.items():
            item, n_words, words, tail = model.queries[q]
            found = sequence >= settings.verbatim or (
                sequence >= settings.paraphrase and answer >= settings.answer
            )
            if n_words < settings.short:
                found = sequence >= 1
            if found:
                sums = items.setdefault((text, item), [0.0, 0.0, 0.0, 0.0])
                sums[0] = max(sums[0], cosine)
                sums[1] += sequence * len(words) / n_words
                sums[2] = max(sums[2], answer)
                sums[3] += len(words) / n_words
        return [
            (text, item, s[0], s[1], s[2]) for (text, item), s in sorted(items.items(), key=lambda x: x[0][0]) if s[3] >= 0.5
        ]

    def candidates(self, rows: Passages) -> Iterator[tuple[int, int, float]]:
        """(passage, query, TF-IDF cosine) of all pairs to check on the words."""
        model, settings = self.model, self.model.settings
        within, term = rows.spans()
        for a in range(0, int(rows.first[-1]), 2048):
            n = min(2048, int(rows.first[-1]) - a)
            b, e = np.searchsorted(within, (a, a + n))
            held = row_sums(within[b:e] - a, term[b:e], self.times, n)
            some = held >= (self.need + 1) // 2  # the latent space decides on these
            # A passage whose weight lies outside the benchmark's terms cannot reach the cosine.
            near = rows.share[a : a + n] >= settings.cosine
            wanted = np.flatnonzero(near)
            cosine = np.zeros((n, len(model.queries)), np.float32)
            cosine[wanted] = rows.project(self.own, wanted + a)
            wanted = np.flatnonzero(some.any(1))
            folded = rows.project(model.space, wanted + a)
            folded /= np.maximum(np.linalg.norm(folded, axis=1, keepdims=True), 1e-12)
            meant = (held >= self.need) | (cosine >= settings.cosine)
            meant[wanted] |= some[wanted] & (folded @ model.latent.T >= settings.latent)
            rest = np.flatnonzero(meant.any(1) & ~near)
            cosine[rest] = rows.project(self.own, rest + a)
            for i, q in zip(*np.nonzero(meant)):
                yield a + int(i), int(q), float(cosine[i, q])

    def _check(self, rows: Passages, passage: int, q: int, cosine: float) -> tuple[float, float, float] | None:
        """Shares of a query and its answer around a passage; None where too few of its words stand."""
        _, _, words, tail = self.model.queries[q]
        text = rows.text[passage]
        first, end = rows.words.first[text], rows.words.first[text + 1]
        half = self.model.settings.window // 2
        begin = first + (passage - rows.first[text]) * half
        near = slice(max(first, begin - len(words)), min(end, begin + 3 * half + len(words)))
        terms, times = self.asked[q]
        self.met[rows.at[near]] = True
        enough = int(times[self.met[terms]].sum()) >= self.need[q]
        self.met[rows.at[near]] = False
        if not enough:
            return None
        region = rows.words.hash[near]
        sequence = common_sequence(region, self.masks[q][0], len(words)) / len(words)
        answer = common_sequence(region, self.masks[q][1], len(tail)) / len(tail) if len(tail) else 1.0
        return sequence, answer, cosine


class Finders:
    """The finders of all blocks, made once per worker."""

    def __init__(self, models: list[Model]):
        self.models = models
        self.made: list[Finder] | None = None

    def __getstate__(self):
        return {"models": self.models, "made": None}

    def find(self, texts: list[bytes]) -> list[tuple]:
        if self.made is None:
            self.made = [Finder(m) for m in self.models]
        return [
            (a + hit[0], *hit[1:])
            for finder in self.made
            for a, b in pieces(texts)
            for hit in finder.find(texts[a:b])
        ]


def models(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> list[Model]:
    """One model per block of the benchmark."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    n_blocks = max(1, -(-_n_queries(benchmark, settings) // settings.block_items))
    out = []
    for block in range(n_blocks):
        rows = (
            benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
            .select("item_id", "text", answer.alias("answer"))
            .collect()
        )
        model = train(docs, sorted((tuple(r) for r in rows), key=repr), settings)
        if model is not None:
            out.append(model)
    return out


def _n_queries(benchmark: DataFrame, settings: Settings) -> int:
    n_words = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    return benchmark.agg(F.coalesce(F.sum(F.ceil(n_words / settings.window)), F.lit(0))).first()[0]


def search(docs: DataFrame, found: list[Model], item_kind: str = "bigint") -> DataFrame:
    """doc_id, item_id, cosine, sequence_share, answer_share of every item found in a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    finders = Finders(found)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hits = finders.find(lowered(strings(batch.column(1))))
        if not hits:
            return None
        at, item, cosine, sequence, answer = zip(*hits)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(item),
                *(pa.array(c, pa.float64()) for c in (cosine, sequence, answer)),
            ],
            ["doc_id", "item_id", "cosine", "sequence_share", "answer_share"],
        )

    return map_arrow(
        docs.select("doc_id", "text"),
        work,
        f"doc_id {kind}, item_id {item_kind}, cosine double, sequence_share double, answer_share double",
    )


def clean(docs: DataFrame, found: list[Model]) -> DataFrame:
    """The rows in which no item is found, with all columns."""
    finders = Finders(found)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("text")
        keep = np.ones(batch.num_rows, bool)
        for hit in finders.find(lowered(strings(batch.column(at)))):
            keep[hit[0]] = False
        return batch.filter(pa.array(keep))

    if not found:
        return docs
    return in_small_batches(docs).mapInArrow(lambda batches: map(work, batches), docs.schema)

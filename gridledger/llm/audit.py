"""Filter interaction audit: what each filter removes under every order of the filters.

A document fails some of the filters; whether it survives depends on the set of filters applied, not on
their order. So each document becomes one 32-bit survival word: bit S is set when the document passes
every filter of the subset S (a truth table over the 2**5 subsets). The survivors of all 32 subsets, per
part and label, are positional popcounts of these words, added by carry-save adders: fifteen words
give four words of weight 1, 2, 4 and 8, so that bits are counted on four words instead of fifteen.
Everything in the report is a difference of survivor counts: a filter f after the filters P removes
N(P) - N(P and f).

Filters (failure conditions): A fewer than `least_words` words; B distinct words below a share of the
words; C capitals A-Z above a share of the code points; D any of the marks; E the text stands under a
smaller doc_id anywhere in the table, whether that row is removed or not.

Texts are read once. Afterwards rows hold an id, a part, four bits and the SHA-256 digest of the text, which
stands for the text. The least id of each digest comes from one aggregation with partial sums and is
joined back only for digests that several rows hold; a digest with a third of the rows is split by
adaptive execution on that side. Counts leave a task as at most 96 numbers per part.

Defined results: a null text is empty (it fails A, and as 0 < 0 does not hold, neither B nor C); a null
lang is the part ''; a null doc_id never fails E and makes no other row fail it; rows repeated with
the same id and text are all counted and none makes the other fail E; a doc_id with several label rows is
good (toxic) if one of them says so; missing labels are neither; an empty table gives no rows. Additional
columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import in_small_batches, map_arrow, stored, strings

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
LABELS = ("all", "good", "toxic")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


@dataclass(frozen=True)
class Settings:
    least_words: int = 100
    distinct_percent: int = 80
    capital_percent: int = 10
    marks: bytes = b"#$%&*|"


def failed_rules(text: str, settings: Settings = Settings()) -> int:
    """Bits of the filters A to D that a text fails. Words are runs of bytes that are not blank."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        (len(words) < settings.least_words)
        | (100 * len(set(words)) < settings.distinct_percent * len(words)) << 1
        | (100 * capitals > settings.capital_percent * len(text)) << 2
        | (len(data) != len(data.translate(None, settings.marks))) << 3
    )


def judged(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, part, failed (bits of A to D), digest of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(batch.column(2))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(strings(batch.column(1)), pa.string()),
                pa.array([failed_rules(t, settings) for t in texts], pa.int32()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts], pa.binary()),
            ],
            ["doc_id", "part", "failed", "digest"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text"),
        work,
        f"doc_id {kind}, part string, failed int, digest binary",
    )


def truth_words() -> np.ndarray:
    """Survival word of each of the 32 sets of failed filters."""
    subsets = np.arange(SUBSETS)
    return np.array(
        [np.bitwise_or.reduce((1 << subsets[(subsets & failed) == 0]).astype(np.uint32)) for failed in subsets],
        np.uint32,
    )


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three words, bit by bit: sums and carries."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def positional_popcounts(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set."""
    lanes = -(-len(words) // 15)
    full = np.zeros((15, lanes), np.uint32)
    full.ravel()[: len(words)] = words
    planes, weight = list(full), 1
    counts = np.zeros(32, np.int64)
    while planes:
        carries = []
        while len(planes) > 2:
            total, carry = _add(*planes[:3])
            planes = [total, *planes[3:]]
            carries.append(carry)
        # 15, 7, 3 and 1 words of a weight add up without a remainder of two.
        bits = np.unpackbits(np.ascontiguousarray(planes[0]).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        counts += weight * bits.sum(axis=0, dtype=np.int64)
        planes, weight = carries, weight * 2
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """part, label, subset, n: documents that survive each subset. `rows` has part, failed, good, toxic."""
    table = truth_words()

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = batch.column(0).dictionary_encode()
            which = parts.indices.to_numpy()
            words = table[batch.column(1).to_numpy()]
            marks = [np.ones(len(words), bool), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
            for i, part in enumerate(parts.dictionary.to_pylist()):
                own = which == i
                counts = held.setdefault(part, np.zeros((len(LABELS), SUBSETS), np.int64))
                for row, mark in zip(counts, marks):
                    row += positional_popcounts(words[own & mark])
            if len(held) > 2000:  # as many parts as rows would otherwise grow here
                yield _counted(held)
                held = {}
        if held:
            yield _counted(held)

    sums = in_small_batches(rows.select("part", "failed", "good", "toxic")).mapInArrow(
        run, "part string, label int, subset int, n bigint"
    )
    return sums.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def _counted(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    size = len(LABELS) * SUBSETS
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p in held for _ in range(size)], pa.string()),
            pa.array(np.tile(np.repeat(np.arange(len(LABELS), dtype=np.int32), SUBSETS), len(held))),
            pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(LABELS) * len(held))),
            pa.array(np.concatenate([c.ravel() for c in held.values()])),
        ],
        ["part", "label", "subset", "n"],
    )


def steps() -> list[tuple[str, int, int, int]]:
    """order, step, filter and subset applied before it, of all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[i] for i in order), step, f, before))
            before |= 1 << f
    return out


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the survivor counts."""
    orders = steps()
    names = [o for o, *_ in orders]
    step, f, before = (np.array([o[i] for o in orders]) for i in (1, 2, 3))
    after, alone = before | (1 << f), 1 << f
    rest = (SUBSETS - 1) ^ alone

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts, columns = [], []
        for part, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = np.zeros((len(LABELS), SUBSETS), np.int64)
            for e in entries:
                n[e["label"], e["subset"]] = e["n"]
            lost = n[:, before] - n[:, after]
            whole = np.bincount(f, lost[0], len(FILTERS)).astype(np.int64)
            parts += [part] * len(orders)
            columns.append((
                n[0, after], lost[0], n[0, 0] - n[0, alone] - lost[0], n[0, rest] - n[0, SUBSETS - 1],
                lost[1], lost[2], whole[f],
            ))
        numbers = [pa.array(np.concatenate(c)) for c in zip(*columns)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(parts, pa.string()),
                pa.array(names * batch.num_rows, pa.string()),
                pa.array(np.tile(step.astype(np.int32), batch.num_rows)),
                *numbers,
            ],
            ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
        )

    # 96 entries per part at most.
    whole = counts.groupBy("part").agg(F.collect_list(F.struct("label", "subset", "n")).alias("entries"))
    return map_arrow(
        whole,
        work,
        "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
        "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    )


def failures(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, part, failed (bits of A to E), good, toxic of every row."""
    rows = stored(judged(docs, settings), "judged")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    repeated = first.filter("first < last").select("digest", "first")
    marks = (
        labels.filter("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    )
    late = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    return (
        rows.join(repeated, "digest", "left")
        .select("doc_id", "part", (F.col("failed") + late).alias("failed"))
        .join(marks, "doc_id", "left")
        .select(
            "doc_id", "part", "failed",
            F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(survivors(failures(docs, labels, settings)))

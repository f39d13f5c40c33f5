"""Removal of repeated byte strings: a depth-limited radix sort of sampled suffixes.

Two suffixes that agree on the first `length` bytes are a repeated window. Sorting all suffixes of a
corpus that deep would move each byte hundreds of times, so the passes work on few suffixes first and
keep only those whose group has more than one member:

* Sampling. Each window hands over to one suffix: the one at its minimizer, the place of the least
  hash among its 64-byte strings. Equal windows choose the same place, so all their occurrences meet.
  Neighbouring windows share minimizers; a stretch of windows with one minimizer is a run.
* First digit: the 64 bytes at the minimizer. Runs alone in their group hold no repeated window.
* Whole run: runs equal in all bytes that their windows cover (a second, deeper digit). Such runs are
  repeated as a whole, and one of them stands for all in the next pass.
* Last digit, the full depth: within a group of the first digit the runs left differ somewhere; their
  windows are compared one by one through 64-bit hashes of all `length` bytes. Equal groups are
  exactly the repeated windows.

Counts of the first two passes are combined before they are shuffled. A first-digit group is worked
on in one task only up to `group_limit` runs; the windows of larger groups are counted as rows by
their hash, again combined first. Each group of the last digit compares by the 64-bit hash together
with the 64-bit first digit.

Strings are judged on the input; matches do not cross texts. Defined results: null is empty text;
empty texts, and texts shorter than `length`, stay whole; repeated rows repeat all their windows.
Additional columns are not read by `removals`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import (
    U64,
    RangeHash,
    map_arrow,
    map_units,
    mix64,
    pieces,
    ranges,
    stored,
    strings,
)


@dataclass(frozen=True)
class Settings:
    length: int = 400  # bytes of a window
    gram: int = 64  # bytes of the first digit
    group_limit: int = 2000  # runs of a first-digit group that one task compares


HIGH = U64(0xFFFFFFFF00000000)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts, each followed by one byte, and where each begins."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return data, np.concatenate(([0], np.cumsum(sizes)))


def runs(texts: list[bytes], settings: Settings) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: text index, minimizer, first and last window (places
    within the text), hash of all bytes covered, hash of the first digit."""
    length, gram = settings.length, settings.gram
    width = length - gram + 1
    data, offset = joined(texts)
    start = ranges(offset[:-1], np.maximum(np.diff(offset) - length, 0))
    if not len(start):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),) * 2
    ranged = RangeHash(data)
    places = len(data) - gram + 1
    score = (ranged.prefix[gram:] - ranged.prefix[:-gram]) * ranged.back[:places]
    # The place in the low half lets the leftmost of equal hashes win.
    score = (score & HIGH) | np.arange(places, dtype=U64)
    score = np.concatenate((score, np.full(-places % width, ~U64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(score, axis=1).ravel()
    behind = np.minimum.accumulate(score[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[start], ahead[start + width - 1])
    place = (least & ~HIGH).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    low, high = start[first], start[np.concatenate((first[1:], [len(start)])) - 1]
    at = place[first]
    shape = (at - low).astype(U64) | ((high - low).astype(U64) << U64(32))
    whole = mix64(ranged.of(low, high + length) ^ mix64(shape))
    text = np.searchsorted(offset, low, side="right") - 1
    begin = offset[text]
    return text, at - begin, low - begin, high - begin, whole, ranged.of(at, at + gram)


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, two 64-bit keys of the row, and its text compressed, as it is shuffled."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=1)
        texts = [squeeze.compress(t.encode("utf-8")) for t in strings(batch.column(3))]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(texts, pa.binary())],
            ["doc_id", "row_key", "text_key", "packed"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        keyed(docs), work, f"doc_id {kind}, row_key bigint, text_key bigint, packed binary"
    )


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("text_key"),
        "text",
    )


def all_runs(docs: DataFrame, settings: Settings) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = [t.encode("utf-8") for t in strings(batch.column(3))]
        parts = []
        for a, b in pieces(texts):
            text, *rest = runs(texts[a:b], settings)
            parts.append((text + a, *rest))
        text, _, low, high, whole, digit = (np.concatenate(c) for c in zip(*parts))
        at = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(1).take(at),
                batch.column(2).take(at),
                pa.array(low.astype(np.int32)),
                pa.array(high.astype(np.int32)),
                pa.array(whole.view(np.int64)),
                pa.array(digit.view(np.int64)),
            ],
            ["row_key", "text_key", "low", "high", "whole", "digit"],
        )

    return map_arrow(
        keyed(docs),
        work,
        "row_key bigint, text_key bigint, low int, high int, whole bigint, digit bigint",
    )


def window_hashes(parts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some byte strings: index of the string, place in it, hash."""
    data, offset = joined(parts)
    count = np.maximum(np.diff(offset) - length, 0)
    start = ranges(offset[:-1], count)
    owner = np.repeat(np.arange(len(parts)), count)
    return owner, start - offset[:-1][owner], RangeHash(data).of(start, start + length)


def stretches(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places of one owner as (owner, first, last)."""
    first = np.flatnonzero(
        np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)))
    )
    last = np.concatenate((first[1:], [len(place)])) - 1
    return owner[first], place[first], place[last]


def repeated_windows(contexts: DataFrame, settings: Settings) -> DataFrame:
    """row_key, text_key, low, high: stretches of repeated windows in runs that are no copies.

    `contexts`: row_key, text_key, low, digit, n_runs (in the group), copies, bytes.
    """
    length, limit = settings.length, settings.group_limit
    schema = "row_key bigint, text_key bigint, low int, high int"

    def compare(table: pa.Table) -> pa.Table | None:
        digit = table.column("digit").to_numpy().view(U64)
        single = table.column("copies").to_numpy() == 1
        parts = table.column("bytes").to_pylist()
        out = []
        # Whole groups at a time, of about a million bytes.
        bounds = np.flatnonzero(np.concatenate(([True], digit[1:] != digit[:-1], [True])))
        sizes = np.add.reduceat(np.fromiter(map(len, parts), np.int64, len(parts)), bounds[:-1])
        begin = 0
        while begin < len(sizes):
            end = begin + 1
            total = sizes[begin]
            while end < len(sizes) and total + sizes[end] <= 1 << 20:
                total += sizes[end]
                end += 1
            a, b = bounds[begin], bounds[end]
            owner, place, value = window_hashes(parts[a:b], length)
            owner += a
            order = np.lexsort((value, digit[owner]))
            key, value_sorted = digit[owner][order], value[order]
            same = (key[1:] == key[:-1]) & (value_sorted[1:] == value_sorted[:-1])
            repeated = np.zeros(len(order), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            repeated &= single[owner]
            if repeated.any():
                out.append(stretches(owner[repeated], place[repeated]))
            begin = end
        if not out:
            return None
        owner, first, last = (np.concatenate(c) for c in zip(*out))
        low = table.column("low").to_numpy()[owner]
        at = pa.array(owner)
        return pa.table(
            {
                "row_key": table.column("row_key").take(at),
                "text_key": table.column("text_key").take(at),
                "low": (low + first).astype(np.int32),
                "high": (low + last).astype(np.int32),
            }
        )

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, place, value = window_hashes(batch.column(4).to_pylist(), length)
        at = pa.array(owner)
        low = batch.column(2).to_numpy()[owner] + place
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                batch.column(1).take(at),
                pa.array(low.astype(np.int32)),
                batch.column(3).take(at),
                pa.array(value.view(np.int64)),
                batch.column(5).take(at),
            ],
            ["row_key", "text_key", "low", "digit", "value", "copies"],
        )

    small = map_units(
        contexts.filter(F.col("n_runs") <= limit).select(
            "row_key", "text_key", "low", "digit", "copies", "bytes"
        ),
        "digit",
        compare,
        schema,
    )
    rows = map_arrow(
        contexts.filter(F.col("n_runs") > limit)
        .select("row_key", "text_key", "low", "digit", "bytes", "copies"),
        spread,
        "row_key bigint, text_key bigint, low int, digit bigint, value bigint, copies bigint",
    )
    often = rows.groupBy("digit", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    large = (
        rows.filter("copies = 1")
        .join(often, ["digit", "value"])
        .select("row_key", "text_key", "low", F.col("low").alias("high"))
    )
    return small.unionByName(large)


def removals(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), text of every row.

    `text` is what is left as text: bytes of characters that a removal cut through are left out there."""
    found = stored(all_runs(docs.select("doc_id", "text"), settings), "runs")
    # One row per distinct run, with how often it occurs and one place of it.
    distinct = stored(
        found.groupBy("whole", "digit").agg(
            F.count(F.lit(1)).alias("copies"),
            F.min(F.struct("row_key", "text_key", "low", "high")).alias("place"),
        ),
        "distinct-runs",
    )
    groups = distinct.groupBy("digit").agg(F.count(F.lit(1)).alias("n_runs")).filter("n_runs > 1")
    varied = (
        distinct.join(groups, "digit")
        .select("digit", "n_runs", "copies", "place.*")
        .groupBy("row_key", "text_key")
        .agg(F.collect_list(F.struct("low", "high", "digit", "n_runs", "copies")).alias("runs"))
    )
    texts = packed(docs.select("doc_id", "text"))
    length = settings.length

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        rows = []
        for row_key, text_key, text, places in zip(*(batch.column(i).to_pylist() for i in range(4))):
            data = unpack.decompress(text)
            rows += [
                (row_key, text_key, p["low"], p["digit"], p["n_runs"], p["copies"], data[p["low"] : p["high"] + length])
                for p in places
            ]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["row_key", "text_key", "low", "digit", "n_runs", "copies", "bytes"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # Repeated rows hold the same bytes; one of them is read.
    contexts = stored(
        map_arrow(
            texts.select("row_key", "text_key", "packed")
            .join(varied, ["row_key", "text_key"])
            .dropDuplicates(["row_key", "text_key"])
            .select("row_key", "text_key", "packed", "runs"),
            cut,
            "row_key bigint, text_key bigint, low int, digit bigint, n_runs bigint, copies bigint, bytes binary",
        ),
        "contexts",
    )
    copied = distinct.filter("copies > 1").select("whole", "digit")
    spans = (
        found.join(copied, ["whole", "digit"])
        .select("row_key", "text_key", "low", "high")
        .unionByName(repeated_windows(contexts, settings))
        .groupBy("row_key", "text_key")
        .agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    )
    return map_arrow(
        texts.join(spans, ["row_key", "text_key"], "left").select("doc_id", "packed", "spans"),
        lambda batch: _remove(batch, length),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, "
        "n_spans bigint, kept_sha256 string, kept binary, text string",
    )


def _remove(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    unpack = zstandard.ZstdDecompressor()
    sizes, gone, n_spans, kept = [], [], [], []
    for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
        data = unpack.decompress(text)
        sizes.append(len(data))
        if not spans:
            gone.append(0)
            n_spans.append(0)
            kept.append(data)
            continue
        edge = np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, [s["low"] for s in spans], 1)
        np.add.at(edge, [s["high"] + length for s in spans], -1)
        covered = np.cumsum(edge[:-1]) > 0
        gone.append(int(covered.sum()))
        n_spans.append(int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()))
        kept.append(np.frombuffer(data, np.uint8)[~covered].tobytes())
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            *(pa.array(c, pa.int64()) for c in (sizes, gone, n_spans)),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            pa.array(kept, pa.binary()),
            pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"],
    )

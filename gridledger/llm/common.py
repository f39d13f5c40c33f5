"""Shared helpers: Arrow mapping, written intermediate tables, word hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.session import new_table_dir

# Texts are worked on in pieces of about this many bytes, so that the numpy columns of a task
# stay small however large an Arrow batch is. One longer text is a piece of its own.
PIECE_BYTES = 1 << 20

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame below the shared folder and read it back: later steps survive lost executors
    and do not compute it again."""
    return stored_at(frame, name)[0]


def stored_at(frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The same, with the path, so that the table can be dropped when it has been read for the last time."""
    spark = frame.sparkSession
    path = new_table_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


BATCH_ROWS = 1000  # rows of an Arrow batch: texts are long, and a task holds a batch several times


def in_small_batches(frame: DataFrame) -> DataFrame:
    """The frame itself, with the session's Arrow batches bounded for what maps over it."""
    conf, key = frame.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return frame


def map_arrow(
    frame: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply `work` to every Arrow batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return in_small_batches(frame).mapInArrow(run, schema)


def strings(column: pa.Array) -> list[str]:
    """Values of a string column; null counts as empty."""
    return ["" if v is None else v for v in column.to_pylist()]


def pieces(texts: list[bytes], limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `limit` bytes."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def mix64(values: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection)."""
    v = values.astype(U64, copy=True)
    v ^= v >> U64(30)
    v *= MIX_A
    v ^= v >> U64(27)
    v *= MIX_B
    v ^= v >> U64(31)
    return v


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


POWER = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2**64


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    out = np.empty(n, U64)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * U64(pow(base, have, 1 << 64))
        have += step
    return out


def _room(n: int) -> int:
    """Round up, so that few sizes of power tables are kept."""
    size = 1 << 21
    while size < n:
        size *= 2
    return size


class RangeHash:
    """Hashes of byte ranges of one buffer, each from two prefix values."""

    def __init__(self, data: np.ndarray):
        room = _room(len(data) + 1)
        self.back = powers(pow(POWER, -1, 1 << 64), room)
        self.prefix = np.empty(len(data) + 1, U64)
        self.prefix[0] = 0
        codes = byte_codes()[data]
        codes *= powers(POWER, room)[: len(data)]
        np.cumsum(codes, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.back[start])


@lru_cache(maxsize=1)
def word_bytes() -> np.ndarray:
    """Bytes that belong to words: ASCII letters and digits, and all of non-ASCII characters."""
    keep = np.zeros(256, bool)
    keep[128:] = True
    for low, high in ((b"0", b"9"), (b"a", b"z"), (b"A", b"Z")):
        keep[low[0] : high[0] + 1] = True
    return keep


class Words:
    """Words of some texts: `text` (index of the text), `start`, `end` (bytes), `hash`.

    A word is a longest run of ASCII letters, digits and non-ASCII characters of the lower-cased
    text; `first[i]` to `first[i + 1]` are the words of text i.
    """

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        inside = word_bytes()[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
        self.data = data
        self.start, self.end = edges[0::2], edges[1::2]
        self.hash = RangeHash(data).of(self.start, self.end)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


def lowered(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "replace") for t in texts]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated starts[i], starts[i] + 1, .. of the given lengths."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)


def map_units(
    frame: DataFrame, unit: str, work: Callable[[pa.Table], pa.Table | None], schema: str
) -> DataFrame:
    """Bring the rows of each unit (a bigint key) together and apply `work` to whole units.

    `work` gets several complete units at a time, sorted by the key. Units have to be small:
    callers split larger groups into blocks first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = held.column(unit).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if cut:
                out = work(held.slice(0, cut).combine_chunks())
                if out is not None:
                    yield from out.to_batches()
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            out = work(held.combine_chunks())
            if out is not None:
                yield from out.to_batches()

    placed = in_small_batches(frame).repartition(unit).sortWithinPartitions(unit)
    return placed.mapInArrow(run, schema)


def slices(cost: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `limit` total cost."""
    begin = 0
    total = np.cumsum(cost)
    while begin < len(cost):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield begin, end
        begin = end


def least_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Label of each of n items: the least index it is connected with by the links."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def block_units(
    frame: DataFrame, group: list[str], size: str, node: str, block: int
) -> DataFrame:
    """Split groups into blocks of about `block` members and form a unit of each pair of blocks.

    Adds `unit` (bigint) and `side` (0 or 1). A group of one block gives one unit, within which all
    pairs count; in a unit of two blocks, pairs on different sides count (`crossed` is true).
    Every pair of members meets in exactly one unit, and no unit has more than about 2 * block rows.
    """
    n_blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit(17)), F.col("_blocks")).cast("int")
    return (
        frame.withColumn("_blocks", n_blocks)
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("crossed", F.col("_own") != F.col("_other"))
        .withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
        .withColumn(
            "unit", F.xxhash64(*group, F.least("_own", "_other"), F.greatest("_own", "_other"))
        )
        .drop("_blocks", "_own", "_other")
    )


def unit_pairs(unit: np.ndarray, side: np.ndarray, crossed: np.ndarray, limit: int = 50_000):
    """Index pairs (left, right) that count, unit by unit, in slices of about `limit` pairs."""
    starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
    ends = np.concatenate((starts[1:], [len(unit)]))
    later = np.repeat(ends, ends - starts) - np.arange(len(unit)) - 1
    for a, b in slices(later, limit):
        left = np.repeat(np.arange(a, b), later[a:b])
        right = ranges(np.arange(a, b) + 1, later[a:b])
        meant = ~crossed[left] | (side[left] != side[right])
        if meant.any():
            yield left[meant], right[meant]

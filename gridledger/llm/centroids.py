"""Centroid clustering (Lloyd's rounds) on whole numbers, over subvector dictionaries.

Vectors become whole numbers, floor(scale * x). Chunks of vectors are dictionary-encoded without loss: the
dimensions are cut into blocks, and each block's distinct subvectors form a dictionary with one code
per vector. A block is as wide as dictionaries still pay for: it starts at `widest` dimensions and is halved
until the distinct subvectors are at most a quarter of the vectors, or one dimension is left. In each
round the squared distances of all distinct subvectors to the centroids are computed once, and a vector's
distance is the sum of its codes' entries. Sums per cluster come from counts of codes in the same way.
All arithmetic is in 64-bit integers, so results do not depend on the partitioning.

The encoded chunks are written once; a round maps over them and leaves clusters x (dimensions + 1) numbers per
task, which Spark adds up. Only the centroids themselves come to the driver.

Defined results: vectors with another number of components, or with null or non-finite ones, are left
out, as are null vectors; numbers are held within +-2**26 (components beyond 262,144 at scale 256),
so that distances stay exact; with fewer vectors than clusters every vector starts a centroid; a null vec_id counts as
'' in the hash; rows repeated with an id are vectors of their own, ordered by their components where
hashes tie; an empty table gives no rows. Additional columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import in_small_batches, stored

LIMIT = 1 << 26


@dataclass(frozen=True)
class Settings:
    clusters: int = 40
    rounds: int = 5
    dimensions: int = 64
    scale: float = 256.0
    seed: str = "2:"
    widest: int = 8  # dimensions of a block before halving
    chunk: int = 8192  # vectors encoded together


def usable(vectors: DataFrame, settings: Settings) -> DataFrame:
    """vec_id and `v` (doubles) of the vectors that count."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
        .filter(F.size("v") == settings.dimensions)
        .filter(~bad)
    )


def whole_numbers(flat: np.ndarray, settings: Settings) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * settings.scale), -LIMIT, LIMIT).astype(np.int64).reshape(-1, settings.dimensions)


def dictionaries(numbers: np.ndarray, widest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First dimension, distinct subvectors and code per vector, of each block."""
    todo = [(a, min(a + widest, numbers.shape[1])) for a in range(0, numbers.shape[1], widest)][::-1]
    while todo:
        a, b = todo.pop()
        part = np.ascontiguousarray(numbers[:, a:b])
        # Rows as opaque bytes sort much faster than rows as columns.
        _, first, codes = np.unique(
            part.view(np.dtype((np.void, part.itemsize * (b - a)))).ravel(), return_index=True, return_inverse=True
        )
        if b - a > 1 and len(first) > len(numbers) // 4:
            middle = (a + b + 1) // 2
            todo += [(middle, b), (a, middle)]
        else:
            yield a, part[first], codes


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers of the least width, led by one byte that names it."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + values.astype(f"i{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64)


def encoded(vectors: DataFrame, settings: Settings) -> DataFrame:
    """Chunks: vec_id (array), start, words and codes per block."""

    def pack(ids: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
        blocks = list(dictionaries(numbers, settings.widest))
        offsets = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, ids),
                pa.array([[a for a, _, _ in blocks]], pa.list_(pa.int32())),
                pa.array([[_narrow(words) for _, words, _ in blocks]], pa.list_(pa.binary())),
                pa.array([[_narrow(codes) for _, _, codes in blocks]], pa.list_(pa.binary())),
            ],
            ["vec_id", "start", "words", "codes"],
        )

    def run(batches):
        held_ids, held, n = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held_ids.append(batch.column(0))
            held.append(whole_numbers(batch.column(1).flatten().to_numpy(zero_copy_only=False), settings))
            n += batch.num_rows
            if n >= settings.chunk:
                yield pack(pa.concat_arrays(held_ids), np.concatenate(held))
                held_ids, held, n = [], [], 0
        if n:
            yield pack(pa.concat_arrays(held_ids), np.concatenate(held))

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return in_small_batches(usable(vectors, settings)).mapInArrow(
        run, f"vec_id array<{kind}>, start array<int>, words array<binary>, codes array<binary>"
    )


def _chunks(batch: pa.RecordBatch, dimensions: int):
    """ids, [(start, words, codes)] of each chunk."""
    for i in range(batch.num_rows):
        starts = batch.column(1)[i].as_py()
        widths = np.diff([*starts, dimensions])
        blocks = [
            (a, _wide(words).reshape(-1, width), _wide(codes))
            for a, width, words, codes in zip(starts, widths, batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
        ]
        yield batch.column(0)[i].values, blocks


def nearest(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the least number of equals) and squared distance of each vector of a chunk."""
    total = np.zeros((len(blocks[0][2]), len(centroids)), np.int64)
    for a, words, codes in blocks:
        other = centroids[:, a : a + words.shape[1]]
        partial = np.zeros((len(words), len(centroids)), np.int64)
        for j in range(words.shape[1]):
            partial += (words[:, j, None] - other[None, :, j]) ** 2
        total += partial[codes]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def first_centroids(vectors: DataFrame, settings: Settings) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in the order of the hashes."""
    name = F.concat(F.lit(settings.seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = (
        usable(vectors, settings)
        .select(F.sha2(name, 256).alias("hash"), "v")
        .orderBy("hash", "v")
        .limit(settings.clusters)
        .collect()
    )
    flat = np.array([r["v"] for r in sorted(rows, key=lambda r: (r["hash"], r["v"]))], np.float64)
    return whole_numbers(flat.ravel(), settings)


def next_centroids(chunks: DataFrame, centroids: np.ndarray, settings: Settings) -> np.ndarray:
    """One round: assign, then floor(sum / count) of every cluster that has vectors."""
    k, dims = len(centroids), settings.dimensions

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for _, blocks in _chunks(batch, dims):
                cluster, _ = nearest(blocks, centroids)
                counts += np.bincount(cluster, minlength=k)
                for a, words, codes in blocks:
                    pairs = np.bincount(cluster * len(words) + codes, minlength=k * len(words)).reshape(k, -1)
                    sums[:, a : a + words.shape[1]] += pairs @ words
        some = np.flatnonzero(counts)
        if len(some):
            # Position -1 holds the number of vectors.
            values = np.column_stack((counts[some], sums[some]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(some, dims + 1).astype(np.int32)),
                    pa.array(np.tile(np.arange(-1, dims, dtype=np.int32), len(some))),
                    pa.array(values.ravel()),
                ],
                ["cluster", "position", "value"],
            )

    totals = (
        in_small_batches(chunks)
        .mapInArrow(run, "cluster int, position int, value bigint")
        .groupBy("cluster", "position")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    counts, out = np.zeros(k, np.int64), centroids.copy()
    sums = np.zeros_like(centroids)
    for cluster, position, value in totals:
        if position < 0:
            counts[cluster] = value
        else:
            sums[cluster, position] = value
    some = counts > 0
    out[some] = sums[some] // counts[some, None]
    return out


def cluster(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that counts."""
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    chunks = stored(encoded(vectors, settings), "chunks")
    centroids = first_centroids(vectors, settings)
    for _ in range(settings.rounds if len(centroids) else 0):
        centroids = next_centroids(chunks, centroids, settings)

    def run(batches):
        for batch in batches:
            for ids, blocks in _chunks(batch, settings.dimensions):
                own, distance = nearest(blocks, centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    placed = stored(
        in_small_batches(chunks).mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "clusters"
    )
    inertia = {r[0]: r[1] for r in placed.groupBy("cluster").agg(F.sum("distance")).collect()}
    rows = [
        (i, inertia[i], sum(inertia.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest())
        for i, c in enumerate(centroids.tolist()) if i in inertia
    ]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per cluster, so at most `clusters` rows.
    return placed.join(F.broadcast(told), "cluster").select("vec_id", *placed.columns[1:], *told.columns[1:])

"""Embedding near-duplicates through an inverted multi-index.

Vectors are cut in halves; k-means codebooks of the two halves form a product grid of cells, and every
vector belongs to the cell of its two nearest centroids. A vector searches the cells by the sum of its
two squared distances to the half cells' borders (the bisecting planes), up to a reach. The reach is
measured: a pass over all vectors finds the true neighbours of a sample of them by brute force, and the
reach meets the target recall of these pairs, both over all pairs and on average over the sampled vectors.
It is never less than what neighbours with evenly spread offsets need, and never more than the squared
distance of a neighbour at the threshold, within which nothing is lost. All pairs met are then verified
by the cosine in double precision.

The codebooks are fitted on a bounded sample (`sample_bytes`); every vector is indexed and searches.
Their size grows with the square root of the number of vectors. Equal vectors are one node with a
count. A cell's members are cut into blocks and its searchers into salts, so that a unit of work is
bounded however large a cell is; counts per vector and a spanning forest leave a unit, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing and are components of their own; vectors of different length never link; equal vectors link with
each other; a repeated row is a copy; the component id is the least non-null vec_id. Additional columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import least_linked, map_arrow, map_units, stored
from gridledger.llm.components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.95
    recall: float = 0.99  # share of the sampled vectors' neighbours that the search meets
    queries: int = 512  # sampled vectors of each length whose neighbours are found by brute force
    spread: float = 4.5  # standard deviations of an evenly spread offset that the search covers at least
    cell_members: int = 256  # vectors per cell that the codebook size aims at
    most_centroids: int = 256  # per half
    sample_bytes: int = 64 << 20
    sample_vectors: int = 20_000
    block: int = 1024  # members of a cell per unit
    searchers: int = 8192  # searchers of a block per unit
    seed: int = 5


def usable(column: str) -> Column:
    """Vectors that can link: finite components, not all of them zero."""
    finite = F.forall(
        column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(column, lambda x: x != 0), F.lit(False))


def unit_rows(rows: list[bytes], kind: np.dtype) -> np.ndarray:
    """Vectors of one length, scaled to length 1 in double precision."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(
        0.0, (x * x).sum(1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(1)
    )


def fit_half(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centroids by a few Lloyd steps; empty ones keep their place."""
    centroids = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(10):
        near = squared(x, centroids).argmin(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        has = counts > 0
        centroids[has] = sums[has] / counts[has, None]
    return centroids


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    right = x[:, cut:]
    return x[:, :cut], right if right.shape[1] else np.zeros((len(x), 1))


def border_distances(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own centroid, and squared distance to the plane between it and each other centroid."""
    d = squared(x, centroids)
    own = d.argmin(1)
    between = np.sqrt(squared(centroids, centroids))[own]
    gap = d - d[np.arange(len(x)), own][:, None]
    plane = np.where(between > 1e-12, gap / (2 * np.maximum(between, 1e-12)), 0.0)
    return own, np.square(np.maximum(plane, 0.0))


def search_cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float):
    """Own cell of each vector, and the later cells within reach as (row, cell) arrays.

    A pair in two cells is found from the one with the smaller cell number.
    """
    (own_a, far_a), (own_b, far_b) = (border_distances(h, c) for h, c in zip(halves(x), books))
    k = len(books[1])
    own = own_a * k + own_b
    rows, cells = [], []
    for begin in range(0, len(x), 256):
        part = slice(begin, begin + 256)
        # Multi-sequence order ends at the reach: all cells with a smaller sum are taken.
        row, a, b = np.nonzero(far_a[part][:, :, None] + far_b[part][:, None, :] <= reach)
        cell = a * k + b
        later = cell > own[part][row]
        rows.append(row[later] + begin)
        cells.append(cell[later])
    return own, np.concatenate(rows), np.concatenate(cells)


def fit(nodes: DataFrame, kind: np.dtype, settings: Settings) -> dict[int, tuple]:
    """Codebooks and reach by vector length."""
    out, asked = {}, {}
    threshold = settings.threshold
    for dim, n in sorted(tuple(r) for r in nodes.groupBy("dim").count().collect()):
        most = min(settings.sample_vectors, settings.sample_bytes // (dim * kind.itemsize) + 1)
        rows = (
            nodes.filter(F.col("dim") == dim)
            .orderBy(F.xxhash64("node", F.lit(settings.seed)), "node")
            .limit(most)
            .select("vector", "node")
            .collect()
        )
        x = unit_rows([bytes(r["vector"]) for r in rows], kind)
        k = int(np.clip(round((n / settings.cell_members) ** 0.5), 4, settings.most_centroids))
        k = min(k, len(x))
        rng = np.random.default_rng(settings.seed)
        books = tuple(fit_half(h, k, rng) for h in halves(x))
        # A neighbour at the threshold is sqrt(2 - 2t) away; one dimension gets a share of it.
        reach = settings.spread**2 * (2 - 2 * threshold) / dim
        out[dim] = (books, min(reach, 2 - 2 * threshold))
        asked[dim] = (np.array([r["node"] for r in rows[: settings.queries]]), x[: settings.queries])
    for dim, reach in measured_reach(nodes, out, asked, kind, settings).items():
        out[dim] = (out[dim][0], max(reach, out[dim][1]))
    return out


def needed(one: tuple, other: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Reach at which the pairs (i of one, j of other) are met; both are border distances of the halves."""
    ((a, far_a), (b, far_b)), ((c, far_c), (d, far_d)) = one, other
    first = (a[i] < c[j]) | ((a[i] == c[j]) & (b[i] < d[j]))  # the smaller cell searches
    return np.where(first, far_a[i, c[j]] + far_b[i, d[j]], far_c[j, a[i]] + far_d[j, b[i]])


def measured_reach(
    nodes: DataFrame, codebooks: dict[int, tuple], asked: dict[int, tuple], kind: np.dtype, settings: Settings
) -> dict[int, float]:
    """Reach by vector length that meets the target recall of the sampled vectors' neighbours."""
    steps = (2 - 2 * settings.threshold) * (np.arange(257) / 256) ** 2

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        node, dims = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vectors = batch.column(2).to_pylist()
        keys = []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            books, (ids, q) = codebooks[int(dim)][0], asked[int(dim)]
            x = unit_rows([vectors[i] for i in at], kind)
            i, j = np.nonzero((x @ q.T >= settings.threshold) & (node[at][:, None] != ids[None, :]))
            if len(i):
                near, back = np.unique(i, return_inverse=True)
                sought, which = np.unique(j, return_inverse=True)
                sides = ([border_distances(h, c) for h, c in zip(halves(y), books)] for y in (x[near], q[sought]))
                step = np.minimum(np.searchsorted(steps, needed(*sides, back, which)), len(steps) - 1)
                keys.append(np.column_stack((np.full(len(j), dim), j, step)))
        if not keys:
            return None
        found, n = np.unique(np.concatenate(keys), axis=0, return_counts=True)
        columns = [pa.array(c.astype(np.int32)) for c in found.T]
        return pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], ["dim", "query", "step", "n"])

    pairs = map_arrow(nodes.select("node", "dim", "vector"), work, "dim int, query int, step int, n bigint")
    counts: dict[int, np.ndarray] = {}
    for dim, query, step, n in pairs.groupBy("dim", "query", "step").agg(F.sum("n")).collect():
        counts.setdefault(dim, np.zeros((len(asked[dim][0]), len(steps))))[query, step] = n
    out = {}
    for dim, n in counts.items():
        n = n[n.sum(1) > 0]
        pooled = n.sum(0).cumsum() / n.sum()
        each = (n.cumsum(1) / n.sum(1, keepdims=True)).mean(0)
        out[dim] = float(steps[np.argmax(np.minimum(pooled, each) >= settings.recall - 1e-12)])
    return out


def index(nodes: DataFrame, codebooks: dict[int, tuple], kind: np.dtype) -> DataFrame:
    """node, dim, copies, vector, cell, visits (later cells to search)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims = batch.column(1).to_numpy()
        vectors = batch.column(3).to_pylist()
        cell = np.zeros(len(dims), np.int32)
        visits: list[np.ndarray] = [np.zeros(0, np.int32)] * len(dims)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            books, reach = codebooks[int(dim)]
            own, row, found = search_cells(unit_rows([vectors[i] for i in at], kind), books, reach)
            cell[at] = own
            bounds = np.searchsorted(row, np.arange(len(at) + 1))
            for i, a, b in zip(at, bounds, bounds[1:]):
                visits[i] = found[a:b].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(4)), pa.array(cell), pa.array(visits, pa.list_(pa.int32()))],
            ["node", "dim", "copies", "vector", "cell", "visits"],
        )

    return map_arrow(
        nodes.select("node", "dim", "copies", "vector"),
        work,
        "node bigint, dim int, copies bigint, vector binary, cell int, visits array<int>",
    )


def units(indexed: DataFrame, settings: Settings) -> DataFrame:
    """Rows of the units: members of two blocks of a cell, or of one block with its searchers."""
    searching = indexed.select("node", "dim", "copies", "vector", F.explode("visits").alias("cell"))
    members = indexed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("m"))
    searchers = searching.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("q"))
    cells = members.join(searchers, ["dim", "cell"], "left").select(
        "dim",
        "cell",
        F.ceil(F.col("m") / settings.block).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("q", F.lit(0)) / settings.searchers)).cast("int").alias("salts"),
    )
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    inside = (
        indexed.drop("visits")
        .join(cells, ["dim", "cell"])
        .withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("salt", F.explode(F.when(F.col("own") == F.col("other"), F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.lit(0)))))
        .select(
            F.xxhash64("dim", "cell", F.least("own", "other"), F.greatest("own", "other"), "salt").alias("unit"),
            F.lit(False).alias("searcher"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            (F.col("own") != F.col("other")).alias("crossed"),
            (F.col("salt") == 0).alias("leading"),
            "node", "copies", "vector",
        )
    )
    outside = (
        searching.join(cells, ["dim", "cell"])
        .withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("salt", F.pmod(F.xxhash64("node", F.lit(4)), F.col("salts")).cast("int"))
        .select(
            F.xxhash64("dim", "cell", "own", "own", "salt").alias("unit"),
            F.lit(True).alias("searcher"),
            F.lit(0).alias("side"),
            F.lit(False).alias("crossed"),
            F.lit(False).alias("leading"),
            "node", "copies", "vector",
        )
    )
    return inside.unionByName(outside)


def links(work_units: DataFrame, kind: np.dtype, settings: Settings) -> DataFrame:
    """node, links (vectors linked in this unit), parent (a node it is connected with there)."""
    threshold = settings.threshold

    def one(searcher, side, crossed, leading, node, copies, vectors):
        order = np.argsort(searcher, kind="stable")  # members first
        n = int((~searcher).sum())
        x = unit_rows([vectors[i] for i in order], kind)
        side, node, copies = side[order], node[order], copies[order]
        count = np.zeros(len(x), np.int64)
        left, right = [], []
        compare_members = crossed or leading
        for begin in range(0 if compare_members else n, len(x), 1024):
            rows = np.arange(begin, min(begin + 1024, len(x)))
            near = x[rows] @ x[:n].T >= threshold
            member = rows < n
            if crossed:
                near &= side[rows][:, None] != side[None, :n]
            if not compare_members:
                near[member] = False
            # Each member pair once: the later row meets the earlier ones.
            near &= ~member[:, None] | (np.arange(n)[None, :] < rows[:, None])
            a, b = np.nonzero(near)
            if not len(a):
                continue
            count[rows] += near @ copies[:n]
            count[:n] += copies[rows] @ near
            label = least_linked(len(x), rows[a], b)
            moved = np.flatnonzero(label != np.arange(len(x)))
            left.append(moved)
            right.append(label[moved])
        if not left:
            return None
        label = least_linked(len(x), np.concatenate(left), np.concatenate(right))
        has = np.flatnonzero(count)
        return node[has], count[has], node[label[has]]

    def compare(table: pa.Table) -> pa.Table | None:
        unit = table.column("unit").to_numpy()
        columns = [
            table.column(c).to_numpy() for c in ("searcher", "side", "crossed", "leading", "node", "copies")
        ]
        vectors = table.column("vector").to_pylist()
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        out = []
        for a, b in zip(starts, np.concatenate((starts[1:], [len(unit)]))):
            searcher, side, crossed, leading, node, copies = (c[a:b] for c in columns)
            if searcher.all() or b - a < 2:
                continue
            own = ~searcher
            found = one(searcher, side, crossed[own][0], leading[own][0], node, copies, vectors[a:b])
            if found is not None:
                out.append(found)
        if not out:
            return None
        node, count, parent = (np.concatenate(c) for c in zip(*out))
        return pa.table({"node": node, "links": count, "parent": parent})

    return map_units(work_units, "unit", compare, "node bigint, links bigint, parent bigint")


def near_duplicates(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of `vectors` (vec_id, embedding)."""
    kind = np.dtype(
        np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64
    )
    rows = vectors.select(
        "vec_id", F.when(usable("embedding"), F.col("embedding").cast("array<double>")).alias("embedding")
    ).select("vec_id", "embedding", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")).alias("node"))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [np.array(v, kind).tobytes() for v in batch.column(3).to_pylist()]
        dims = [len(p) // kind.itemsize for p in packed]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
            ["node", "copies", "least", "dim", "vector"],
        )

    id_kind = vectors.schema["vec_id"].dataType.simpleString()
    nodes = stored(
        map_arrow(
            rows.filter("node IS NOT NULL")
            .groupBy("node")
            .agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")),
            pack,
            f"node bigint, copies bigint, least {id_kind}, dim int, vector binary",
        ),
        "vectors",
    )
    indexed = stored(index(nodes, fit(nodes, kind, settings), kind), "indexed")
    linked = stored(links(units(indexed, settings), kind, settings), "vector-links")
    roots = components(linked.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    placed = (
        nodes.select("node", "copies", "least")
        .join(roots, "node", "left")
        .join(linked.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .select(
            "node", "least", F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    placed = stored(placed, "vector-places")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    verdicts = placed.join(least, "root").select("node", "n_links", "component_id")
    own = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "node").join(verdicts, "node", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        own.alias("component_id"),
        F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"),
    )

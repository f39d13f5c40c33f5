"""Near-duplicate join on word shingles: MinHash buckets, Bayesian pruning, exact verification.

1. Sketch. Every text becomes its set of shingles of five words; texts with equal sets are one node
   from here on, with the number of its copies. 96 MinHash values (16 bits each) form 24 bands of 4.
2. Candidates. Nodes that share a band meet. Their MinHash values are compared 16 at a time; a pair
   is dropped as soon as the posterior probability that its similarity reaches the threshold
   (uniform prior, binomial matches) falls below the tolerance. What is left links nodes into probable
   groups: first every node with the least one of its bucket, then, where a bucket still holds several
   groups, nodes of different groups.
3. Verification. Within each probable group all pairs are compared exactly on their whole shingle
   sets. Counts per node and a spanning forest of the true links leave a task, never all pairs.

Buckets and groups of any size are cut into blocks; each pair of blocks is a unit of bounded size,
so no key is ever gathered into one task. Nothing is capped.

A pair with similarity of exactly 0.8 shares no band with probability 4e-6, less above it; pruning
loses one with about the tolerance at each of six looks.

Words are longest runs of ASCII letters, digits and non-ASCII characters of the lower-cased text. A
text of one to four words is one shingle. Defined results: null, empty and wordless texts link with
nothing and are classes of their own (class_id is their doc_id); repeated rows are copies of each
other; a class id is the least non-null doc_id in the class. Additional columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import (
    U64,
    Words,
    block_units,
    least_linked,
    lowered,
    map_arrow,
    map_units,
    mix64,
    pieces,
    ranges,
    slices,
    stored,
    strings,
    unit_pairs,
)
from gridledger.llm.components import components


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    bands: int = 24
    rows: int = 4  # 16-bit values per band, 64 bits in all
    look: int = 16  # MinHash values compared between two decisions
    tolerance: float = 1e-6
    block: int = 64  # nodes of a bucket per block
    group_block: int = 256  # texts of a probable group per block

    @property
    def values(self) -> int:
        return self.bands * self.rows


SHINGLE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], U64)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of lower-cased texts: (owner, hash), sorted by both."""
    words = Words(texts)
    n = np.diff(words.first)
    factor = mix64(np.arange(1, k + 1, dtype=U64) * SHINGLE[0]) | U64(1)
    total = len(words.hash)
    rolled = np.zeros(max(0, total - k + 1), U64)
    for j in range(k):
        rolled += words.hash[j : j + len(rolled)] * factor[j]
    full = np.maximum(n - k + 1, 0)
    at = ranges(words.first[:-1], full)
    owner = np.repeat(np.arange(len(texts)), full)
    found = mix64(rolled[at])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        # One shingle of all words, told from longer ones by their number.
        whole = [
            int((words.hash[a:b] * factor[: b - a]).sum(dtype=U64)) for a, b in zip(words.first[short], words.first[short + 1])
        ]
        extra = mix64(np.array(whole, U64) ^ (n[short].astype(U64) * SHINGLE[1]))
        owner, found = np.concatenate((owner, short)), np.concatenate((found, extra))
        order = np.argsort(owner, kind="stable")
        owner, found = owner[order], found[order]
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], found[new]


def signatures(owner: np.ndarray, found: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with shingles, a 64-bit digest of each one's set, and its MinHash values."""
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    digest = np.add.reduceat(mix64(found ^ SHINGLE[2]), starts)
    short = (found >> U64(32)).astype(np.uint32)
    keys = mix64(np.arange(1, values + 1, dtype=U64) * SHINGLE[1])
    sketch = np.empty((len(starts), values), np.uint16)
    for i, key in enumerate(keys):
        moved = (short ^ np.uint32(key & U64(0xFFFFFFFF))) * np.uint32((key >> U64(32)) | U64(1))
        least = np.minimum.reduceat(moved, starts)
        sketch[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return owner[starts], digest, sketch


def sketches(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, row key, node (null without words), sketch of every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = lowered(strings(batch.column(3)))
        nodes: list[int | None] = [None] * len(texts)
        kept: list[bytes | None] = [None] * len(texts)
        for a, b in pieces(texts):
            owner, found = shingles(texts[a:b], settings.words)
            if not len(owner):
                continue
            which, digest, sketch = signatures(owner, found, settings.values)
            for i, node, row in zip(which + a, digest.view(np.int64).tolist(), sketch):
                nodes[i], kept[i] = node, row.tobytes()
        return pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(3)), pa.array(nodes, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "row_key", "text_key", "node", "sketch"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        keyed(docs).select("doc_id", "row_key", "text_key", "text"),
        work,
        f"doc_id {kind}, row_key bigint, text_key bigint, node bigint, sketch binary",
    )


def keyed(docs: DataFrame) -> DataFrame:
    """Adds two 64-bit keys that name a row by its id and text, also where the id is null."""
    return docs.withColumns(
        {
            "row_key": F.xxhash64("doc_id", "text"),
            "text_key": F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))),
        }
    )


def least_matches(settings: Settings) -> list[int]:
    """Least matches among the first look, 2 look, .. values at which a pair stays a candidate.

    With a uniform prior, m matches of k give P(similarity >= t) = P(Binomial(k + 1, t) <= m).
    """
    out = []
    for k in range(settings.look, settings.values + 1, settings.look):
        below, m = 0.0, -1
        while below < settings.tolerance:
            m += 1
            below += comb(k + 1, m) * settings.threshold**m * (1 - settings.threshold) ** (k + 1 - m)
        out.append(m)
    return out


def _matrix(column: pa.ChunkedArray, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _bands(nodes: DataFrame, settings: Settings) -> DataFrame:
    """key, node, band: the buckets of each node."""
    bands = settings.bands

    def band_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketch = _matrix(pa.chunked_array([batch.column(1)]), np.uint64, bands)
        salt = mix64(np.arange(1, bands + 1, dtype=U64) * SHINGLE[2])
        keys = mix64(sketch ^ salt).view(np.int64).ravel()
        node = np.repeat(batch.column(0).to_numpy(), bands)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys), pa.array(node), pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows))],
            ["key", "node", "band"],
        )

    return map_arrow(nodes.select("node", "sketch"), band_keys, "key bigint, node bigint, band int")


def _unpruned(a: np.ndarray, b: np.ndarray, settings: Settings, least: list[int]) -> np.ndarray:
    """Which rows of two sketch matrices stay candidates, look by look."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        span = slice(i * settings.look, (i + 1) * settings.look)
        matches += (a[alive, span] == b[alive, span]).sum(axis=1)
        stay = matches >= m
        alive, matches = alive[stay], matches[stay]
    return alive


def probable_links(nodes: DataFrame, settings: Settings) -> DataFrame:
    """Edges u, v that connect each group of candidate pairs.

    First every node of a bucket meets only the bucket's least node: as many pairs as nodes, however large
    the bucket. Nodes that this brings to the same node are one group from then on; only buckets that hold several
    groups are searched pair by pair, in blocks, for pairs of different groups, and what leaves
    a task are links between groups.
    """
    least = least_matches(settings)
    members = stored(_bands(nodes, settings), "members")
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), F.min("node").alias("head"))
    buckets = buckets.filter("n_members > 1")
    sketches = nodes.select("node", "sketch")
    stars = members.join(buckets, "key").filter("node <> head").select("node", "head").distinct()
    starred = stars.join(sketches, "node").join(
        sketches.select(F.col("node").alias("head"), F.col("sketch").alias("head_sketch")), "head"
    )

    def near_head(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, head = (_matrix(pa.chunked_array([batch.column(i)]), np.uint16, settings.values) for i in (2, 3))
        kept = pa.array(_unpruned(own, head, settings, least))
        return pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept)], ["u", "v"])

    first = stored(
        map_arrow(starred.select("node", "head", "sketch", "head_sketch"), near_head, "u bigint, v bigint"), "stars"
    )
    # The least head of a node, and that one's: near copies of one text come to the same.
    heads = first.groupBy("u").agg(F.min("v").alias("head"))
    further = heads.select(F.col("u").alias("head"), F.col("head").alias("root"))
    groups = heads.join(further, "head", "left").select(F.col("u").alias("node"), F.coalesce("root", "head").alias("root"))
    grouped = members.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    grouped = stored(grouped, "grouped")
    mixed = grouped.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_members"), F.min("root").alias("low"), F.max("root").alias("high")
    ).filter("low <> high").select("key", "n_members")
    met = grouped.join(mixed, "key").join(sketches, "node")
    units = block_units(met, ["key"], "n_members", "node", settings.block).select(
        "unit", "band", "side", "crossed", "root", "sketch"
    )

    def compare(table: pa.Table) -> pa.Table | None:
        unit, side, crossed, band, root = (
            table.column(c).to_numpy() for c in ("unit", "side", "crossed", "band", "root")
        )
        sketch = _matrix(table.column("sketch"), np.uint16, settings.values)
        wide = sketch.view(np.uint64)
        links = []
        for left, right in unit_pairs(unit, side, crossed):
            other = root[left] != root[right]
            left, right = left[other], right[other]
            # A pair counts in the first band it shares, so that it is looked at once.
            first = (wide[left] == wide[right]).argmax(axis=1) == band[left]
            left, right = left[first], right[first]
            kept = _unpruned(sketch[left], sketch[right], settings, least)
            if len(kept):
                links.append((left[kept], right[kept]))
        if not links:
            return None
        ids, place = np.unique(root, return_inverse=True)
        left, right = (place[np.concatenate(side)] for side in zip(*links))
        label = least_linked(len(ids), left, right)
        linked = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"u": ids[linked], "v": ids[label[linked]]})

    second = map_units(units, "unit", compare, "u bigint, v bigint").distinct()
    return first.unionByName(second)


def exact_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """node, links (rows linked in this unit), parent (a node it is connected with in the unit).

    `nodes` gives a row that holds the node's text, `groups` the probable group of each node.
    """
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n_members"))
    placed = (
        nodes.select("node", "copies", F.col("holder.row_key").alias("row_key"), F.col("holder.text_key").alias("text_key"))
        .join(groups, "node")
        .join(sizes, "root")
    )
    texts = keyed(docs.select("doc_id", "text")).select("row_key", "text_key", "text")
    units = block_units(
        texts.join(placed, ["row_key", "text_key"]), ["root"], "n_members", "node", settings.group_block
    ).select("unit", "side", "crossed", "node", "copies", "text")
    threshold = settings.threshold

    def compare(table: pa.Table) -> pa.Table | None:
        out: list[tuple[np.ndarray, ...]] = []
        unit = table.column("unit").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
        for a, b in zip(starts, np.concatenate((starts[1:], [len(unit)]))):
            part = table.slice(a, b - a)
            node, first = np.unique(part.column("node").to_numpy(), return_index=True)
            if len(node) < 2:
                continue
            side = part.column("side").to_numpy()[first]
            copies = part.column("copies").to_numpy()[first]
            column = part.column("text")
            texts = lowered([column[int(i)].as_py() or "" for i in first])
            near = similar(texts, settings.words, threshold)
            if part.column("crossed")[0].as_py():
                near &= side[:, None] != side[None, :]
            links = near @ copies
            left, right = np.nonzero(np.triu(near, 1))
            label = least_linked(len(node), left, right)
            has = np.flatnonzero(links)
            out.append((node[has], links[has], node[label[has]]))
        if not out:
            return None
        node, links, parent = (np.concatenate(c) for c in zip(*out))
        return pa.table({"node": node, "links": links.astype(np.int64), "parent": parent})

    return map_units(units, "unit", compare, "node bigint, links bigint, parent bigint")


def similar(texts: list[bytes], k: int, threshold: float) -> np.ndarray:
    """Which pairs of texts reach the similarity, from their whole shingle sets; not the diagonal."""
    owners, hashes = [], []
    for a, b in pieces(texts):
        owner, found = shingles(texts[a:b], k)
        owners.append(owner + a)
        hashes.append(found)
    owner, found = np.concatenate(owners), np.concatenate(hashes)
    size = np.bincount(owner, minlength=len(texts)).astype(np.float64)
    order = np.argsort(found, kind="stable")
    owner, found = owner[order], found[order]
    starts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    counts = np.diff(np.concatenate((starts, [len(found)])))
    starts, counts = starts[counts > 1], counts[counts > 1]
    common = np.zeros((len(texts), len(texts)))
    for a, b in slices(np.full(len(starts), len(texts)), 4_000_000):
        slab = np.zeros((len(texts), b - a), np.float32)
        slab[owner[ranges(starts[a:b], counts[a:b])], np.repeat(np.arange(b - a), counts[a:b])] = 1
        common += slab @ slab.T
    near = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-9
    near &= common > 0
    np.fill_diagonal(near, False)
    return near


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, row_key, text_key, class_id, n_links, keeper: one row per row of `docs`.

    n_links counts the other rows at or above the threshold, copies included; keeper marks the row
    that stays of each class (repeated rows of the same id and text share it).
    """
    rows = stored(sketches(docs, settings), "sketches")
    holder = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key", "text_key")
    nodes = stored(
        rows.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(holder).alias("holder"), F.first("sketch").alias("sketch")),
        "nodes",
    )
    groups = stored(components(probable_links(nodes, settings)), "groups")
    links = stored(exact_links(docs, nodes, groups, settings), "links")
    classes = components(links.select(F.col("node").alias("u"), F.col("parent").alias("v")))
    linked = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.select("node", "copies", "holder")
        .join(classes, "node", "left")
        .join(linked, "node", "left")
        .select(
            "node", "copies", "holder",
            F.coalesce("root", "node").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    placed = stored(placed, "placed")
    heads = placed.groupBy("root").agg(F.min("holder").alias("head"))
    verdicts = placed.join(heads, "root").select("node", "n_links", "head")
    named = F.col("node").isNotNull()
    head = F.col("head")
    return rows.drop("sketch").join(verdicts, "node", "left").select(
        "doc_id",
        "row_key",
        "text_key",
        F.when(named, head["doc_id"]).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce((F.col("row_key") == head["row_key"]) & (F.col("text_key") == head["text_key"]), F.lit(True)).alias("keeper"),
    )


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, with all columns; rows without words stay (repeated ones once)."""
    columns = docs.columns
    keys = ["row_key", "text_key"]
    rows = stored(near_duplicates(docs, settings).filter("keeper").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "kept")
    clash = [c for c in columns if c in keys]
    plain = keyed(docs.withColumnsRenamed({c: f"_own_{c}" for c in clash}))
    # Texts are only filtered. Rows repeated with id and text, of which one stays, are the one exception.
    alone = plain.join(rows.filter("n = 1"), keys, "left_semi")
    repeated = plain.join(rows.filter("n > 1"), keys, "left_semi")
    if rows.filter("n > 1").isEmpty():
        kept = alone
    else:
        kept = alone.unionByName(repeated.dropDuplicates(keys))
    back = {f"_own_{c}": c for c in clash}
    return kept.drop(*keys).withColumnsRenamed(back).select(*(F.col(f"`{c}`") for c in columns))

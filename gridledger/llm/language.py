"""Language model of words: a hierarchical Pitman-Yor process, seated by Gibbs sampling.

Each word is a context with a restaurant of its own: its customers are the training tokens that follow it,
its dishes their words. All context restaurants share one parent, the restaurant of the whole corpus, whose
customers are the tables of its children and whose base is uniform over the known words and one unknown.
With counts c and tables t, a sample predicts

    P(w | u) = (c_uw - d t_uw + (strength + d T_u) P(w)) / (strength + C_u)

and a text's score is the sum of log10 of the mean of P over the kept samples.

Gibbs step. All customers of a dish in a restaurant are reseated at once, given everything else: the number
of their tables has the weight S(c, t) * prod_{j < t}(strength + d (T + j)) * P(w)^t, with S the
generalised Stirling numbers, which count the seatings. Up to `exact` customers t is drawn from all its
values; above, where the numbers come from a saddle point, by Metropolis steps (work then does not
grow with c). A dish of one customer has one table, so only dishes of two and more take part in the
rounds. Within a round all dishes are drawn in parallel, against the restaurant sizes and parent
probabilities of its begin; the root's tables are drawn anew in every round.

Layout. Texts are cut into words once, in blocks of a bounded number of tokens (or one text), with codes local to
the block. Everything else is exchanged as packed messages between blocks, word parts (q) and pair parts
(p), sorted and narrowed to a few bytes per entry:

    block -> q   distinct words and counts            q -> block   numbers of the words, counts
    block -> p   distinct pairs and counts            p            counts of pairs; states of repeated ones
    state -> q   customers and tables, by word        q -> state   sizes of restaurants, parent's counts
    p, q -> block   counts and tables of what the block asked for; it scores its own texts

A frequent word or pair is one entry per block, so no key gathers rows. Nothing is cut off: every pair
of every text is counted, and every message grows with the input. There are as many parts as `part_bytes` go into
the text. Scalars (totals of the parts) are all that comes to the driver.

Words are runs of bytes that are not blank, A-Z lower-cased; each text has one end after its words, which is also the
context of its first word. Defined results: a null or empty text is its end alone; a null doc_id
counts as training; repeated rows count as often as they stand; without training rows N and V are 0 and
all words have the uniform probability of one unknown; an empty table gives no rows. Draws depend on
the seed and on how rows lie in partitions. Additional columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm.common import in_small_batches, map_units, slices, stored, stored_at
from gridledger.session import drop_folder

CODES, DOCS, WORDS, IDS, PAIRS, STATE, STATIC, SUMS, REPLY, TOTAL, ROOT, COUNTS = range(12)


@dataclass(frozen=True)
class Settings:
    folds: int = 10  # a row whose crc32(doc_id) is divisible by it is held out
    strength: float = 1.0
    burn_in: int = 1  # rounds before the first kept sample
    samples: int = 2
    exact: int = 256  # customers (of WIDTHS) up to which tables are drawn from all values
    steps: int = 16  # Metropolis steps above
    seed: int = 29
    parts: int | None = None  # else so many that each gets about part_bytes of text
    part_bytes: int = 1 << 24
    block_bytes: int = 14 << 20  # text of a block
    row: int = 1 << 15  # entries of a message row
    state_row: int = 1 << 18  # pairs of a state row


# -- messages ------------------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers of the least width each, byte planes apart, compressed."""
    head, body = [len(columns)], []
    for c in columns:
        low, high = (int(c.min()), int(c.max())) if len(c) else (0, 0)
        width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
        head += [width, len(c)]
        body.append(np.ascontiguousarray(c.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    data = np.array(head, "<i8").tobytes() + b"".join(body)
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for width, size in head.tolist():
        plane = np.frombuffer(raw, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(plane.T).view(f"<i{width}").ravel().astype(np.int64))
        at += width * size
    return out


def steps_of(values: np.ndarray) -> np.ndarray:
    """Ascending values as differences."""
    return np.diff(values, prepend=0)


class Outbox:
    """Message rows of one task."""

    def __init__(self, ids: pa.DataType):
        self.rows: list[tuple] = []
        self.ids = ids

    def send(self, to: int, kind: int, sender: int, data: bytes, seq: int = 0, ids=None) -> None:
        self.rows.append((to, kind, sender, seq, data, ids))

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows)) if self.rows else [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.list_(self.ids))
        self.rows = []
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["to", "kind", "sender", "seq", "data", "ids"])


def schema_of(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"to bigint, kind int, sender bigint, seq int, data binary, ids array<{kind}>"


def deliver(table: pa.Table, work: Callable[[int, dict], None]) -> None:
    """Call `work` with every receiver and its messages by kind: (sender, seq, data, ids), in order."""
    to = table.column("to").to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    for a, b in zip(starts, [*starts[1:], len(to)]):
        part = table.slice(a, b - a)
        boxes = defaultdict(list)
        columns = [part.column(c).to_pylist() for c in ("kind", "sender", "seq", "data")]
        held = part.column("ids")
        for i, (kind, sender, seq, data) in enumerate(zip(*columns)):
            boxes[kind].append((sender, seq, data, held[i].values if kind == DOCS else None))
        for box in boxes.values():
            box.sort(key=lambda m: m[:2])
        work(int(to[a]), boxes)


def by_receiver(messages: DataFrame, work: Callable[[int, dict, Outbox], None]) -> DataFrame:
    """Deliver messages; `work` puts new ones into its outbox."""

    def run(table: pa.Table) -> pa.Table | None:
        out = Outbox(table.schema.field("ids").type.value_type)
        deliver(table, lambda to, boxes: work(to, boxes, out))
        return out.table() if out.rows else None

    return map_units(messages, "to", run, schema_string(messages))


def schema_string(messages: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in messages.schema)


# -- texts into codes, words into numbers --------------------------------------------------------


def coded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of some texts as codes, an end (0) after each text; tokens per text; the words by code."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = ~BLANK[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside)).view(np.int8)))
    start, end = edges[0::2], edges[1::2]
    letters = data[inside]
    offsets = np.concatenate(([0], np.cumsum(end - start)))
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)]
    found = pa.Array.from_buffers(pa.large_binary(), len(start), buffers).dictionary_encode()
    closes = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    until = np.searchsorted(start, closes)
    own = np.diff(until, prepend=0)
    codes = np.zeros(len(start) + len(texts), np.int32)
    codes[np.arange(len(start)) + np.repeat(np.arange(len(texts)), own)] = found.indices.to_numpy() + 1
    return codes, own + 1, found.dictionary


BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def tokenised(docs: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """CODES and DOCS of every block (to the block), and its WORDS (to the word parts).

    The end of a text is the empty word; a block's word 0 is the end.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % settings.folds == 0, F.lit(False))

    def flush(block: int, texts: list[bytes], flags: list, ids: list, out: Outbox) -> pa.Table:
        code, lengths, words = coded(texts)
        names = [b"", *words.to_pylist()]
        train = ~np.array(flags, bool)
        seen = np.bincount(code[np.repeat(train, lengths)], minlength=len(names)).astype(np.int64)
        for seq, a in enumerate(range(0, len(code), settings.row)):
            out.send(block, CODES, block, pack(code[a : a + settings.row]), seq)
        for seq, a in enumerate(range(0, len(lengths), settings.row)):
            b = a + settings.row
            out.send(block, DOCS, block, pack(lengths[a:b], np.array(flags[a:b], np.int64)), seq, ids[a:b])
        part = np.fromiter((zlib.crc32(w) % parts for w in names), np.int64, len(names))
        order = np.argsort(part, kind="stable")
        for q, own in split(part[order], order):
            for seq, a in enumerate(range(0, len(own), settings.row)):
                some = own[a : a + settings.row]
                numbers = pack(some, seen[some])
                text = zstandard.ZstdCompressor(level=3).compress(b" ".join([names[i] for i in some]))
                out.send(q, WORDS, block, len(numbers).to_bytes(4, "little") + numbers + text, seq)
        return out.table()

    def run(batches):
        base, blocks, out = TaskContext.get().partitionId() << 32, count(), None
        texts, flags, ids, size = [], [], [], 0
        for batch in batches:
            out = out or Outbox(batch.column(0).type)
            for i, text, held_out in zip(*(batch.column(j).to_pylist() for j in range(3))):
                texts.append((text or "").encode("utf-8", "replace").lower())
                flags.append(held_out)
                ids.append(i)
                size += len(texts[-1]) + 1
                if size >= settings.block_bytes:
                    yield from flush(base + next(blocks), texts, flags, ids, out).to_batches()
                    texts, flags, ids, size = [], [], [], 0
        if texts:
            yield from flush(base + next(blocks), texts, flags, ids, out).to_batches()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held.alias("held"))
    return in_small_batches(rows).mapInArrow(run, schema_of(docs))


def split(part: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values by part; `part` ascends."""
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield int(part[a]), values[a:b]


def numbered(messages: DataFrame, parts: int) -> DataFrame:
    """IDS (local code, number, count) to the blocks, TOTAL (known words, tokens, words seen once, twice).

    A word's number is its rank by count within its part, times the parts, plus the part.
    """

    def work(q: int, boxes: dict, out: Outbox) -> None:
        words, counts, local = [], [], []
        for _, _, data, _ in boxes[WORDS]:
            cut = 4 + int.from_bytes(data[:4], "little")
            own, n = unpack(data[4:cut])
            words += zstandard.ZstdDecompressor().decompress(data[cut:]).split(b" ")
            counts.append(n)
            local.append(own)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        which = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, which, np.concatenate(counts))
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        at = 0
        for (block, seq, _, _), own in zip(boxes[WORDS], local):
            mine = which[at : at + len(own)]
            at += len(own)
            out.send(block, IDS, q, pack(own, rank[mine] * parts + q, total[mine]), seq)
        known = total[total > 0]
        out.send(q, TOTAL, q, pack(np.array([len(known), known.sum(), (known == 1).sum(), (known == 2).sum()])))

    return by_receiver(messages.filter(F.col("kind") == WORDS), work)


def totals(messages: DataFrame, *group: str) -> dict:
    """Sums of the TOTAL rows (one per part, so as many rows as parts), by `group`."""
    out: dict = {}
    for *key, data in messages.filter(F.col("kind") == TOTAL).select(*group, "data").collect():
        key = tuple(key)
        out[key] = out.get(key, 0) + unpack(data)[0]
    return out


class Block:
    """A block put together again: its texts as numbers of words, and its distinct pairs in order."""

    def __init__(self, boxes: dict, parts: int):
        code = np.concatenate([unpack(m[2])[0] for m in boxes[CODES]])
        docs = [unpack(m[2]) for m in boxes[DOCS]]
        self.lengths, flags = (np.concatenate(c) for c in zip(*docs))
        self.held = flags.astype(bool)
        self.ids = pa.concat_arrays([m[3] for m in boxes[DOCS]])
        local, number, seen = (np.concatenate(c) for c in zip(*(unpack(m[2]) for m in boxes[IDS])))
        order = np.argsort(number)
        rank = np.empty(len(local), np.int64)
        rank[local[order]] = np.arange(len(local))
        self.number, self.seen, self.local_rank = number[order], seen[order], rank
        self.word = rank[code]  # words by the order of their numbers
        end = rank[0]
        context = np.concatenate(([end], self.word[:-1]))
        key, self.pair = np.unique(context * len(local) + self.word, return_inverse=True)
        self.left, self.right = key // len(local), key % len(local)
        u, w = self.number[self.left], self.number[self.right]
        part = pair_part(u, w, parts)
        self.order = np.argsort(part, kind="stable")
        self.part = part[self.order]

    def train_pairs(self) -> np.ndarray:
        weight = np.repeat(~self.held, self.lengths)
        return np.bincount(self.pair[weight], minlength=len(self.left)).astype(np.int64)

    def messages(self, row: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """part, seq and distinct pairs of every PAIRS row."""
        for p, own in split(self.part, self.order):
            for seq, a in enumerate(range(0, len(own), row)):
                yield p, seq, own[a : a + row]


def pair_part(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    mixed = (u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (w.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def paired(texts: DataFrame, ids: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """PAIRS of every block (context, word, training count) to the pair parts."""

    def work(block: int, boxes: dict, out: Outbox) -> None:
        own = Block(boxes, parts)
        n = own.train_pairs()
        for p, seq, some in own.messages(settings.row):
            u, w = own.number[own.left[some]], own.number[own.right[some]]
            out.send(p, PAIRS, block, pack(steps_of(u), w, n[some]), seq)

    return by_receiver(texts.unionByName(ids.filter(F.col("kind") == IDS)), work)


# -- counts of pairs -----------------------------------------------------------------------------


def gathered(box: list) -> tuple[np.ndarray, ...]:
    """context, word and count of the distinct pairs of a part, in order; place of each sent pair."""
    sent = [unpack(m[2]) for m in box]
    u = np.concatenate([np.cumsum(s[0]) for s in sent])
    w = np.concatenate([s[1] for s in sent])
    order = np.lexsort((w, u))
    u, w = u[order], w[order]
    new = np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(new) - 1
    n = np.concatenate([s[2] for s in sent])
    c = np.add.reduceat(n[order], np.flatnonzero(new))
    return u[new], w[new], c, place


def summed(x: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct x and the sums of the values over each."""
    distinct, which = np.unique(x, return_inverse=True)
    out = [distinct]
    for v in values:
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, which, v)
        out.append(total)
    return tuple(out)


def sent_by_word(out: Outbox, kind: int, sender: int, parts: int, row: int, x: np.ndarray, *values: np.ndarray) -> None:
    """Send columns to the parts of the words x."""
    part = x % parts
    order = np.lexsort((x, part))
    for q, own in split(part[order], order):
        for seq, a in enumerate(range(0, len(own), row)):
            some = own[a : a + row]
            out.send(q, kind, sender, pack(steps_of(x[some] // parts), *(v[some] for v in values)), seq)


def counted(pairs: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """STATE of the pairs seen twice and more, STATIC sums of all by word, TOTAL (pairs seen once, twice, at all)."""

    def work(p: int, boxes: dict, out: Outbox) -> None:
        u, w, c, _ = gathered(boxes[PAIRS])
        u, w, c = u[c > 0], w[c > 0], c[c > 0]
        once = (c == 1).astype(np.int64)
        zero = np.zeros(len(c), np.int64)
        x, customers, tables, dishes = summed(
            np.concatenate((u, w)),
            np.concatenate((c, zero)),
            np.concatenate((once, zero)),
            np.concatenate((zero, once)),
        )
        sent_by_word(out, STATIC, p, parts, settings.row, x, customers, tables, dishes)
        often = np.flatnonzero(c > 1)
        for piece, a in enumerate(range(0, len(often), settings.state_row)):
            some = often[a : a + settings.state_row]
            out.send(p << 24 | piece, STATE, p, pack(steps_of(u[some]), w[some], c[some], np.ones(len(some), np.int64)))
        out.send(p, TOTAL, p, pack(np.array([once.sum(), (c == 2).sum(), len(c)])))

    return by_receiver(pairs, work)


def merged_static(messages: DataFrame, settings: Settings) -> DataFrame:
    """STATIC sums of all pair parts added up by word."""

    def work(q: int, boxes: dict, out: Outbox) -> None:
        rows = [unpack(m[2]) for m in boxes[STATIC]]
        rank = np.concatenate([np.cumsum(r[0]) for r in rows])
        columns = [np.concatenate([r[i] for r in rows]) for i in (1, 2, 3)]
        rank, *columns = summed(rank, *columns)
        for seq, a in enumerate(range(0, len(rank), settings.row)):
            b = a + settings.row
            out.send(q, STATIC, q, pack(steps_of(rank[a:b]), *(v[a:b] for v in columns)), seq)

    return by_receiver(messages.filter(F.col("kind") == STATIC), work)


def discount(once: int, twice: int) -> float:
    """From the numbers of things seen once and twice; kept inside (0, 1)."""
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


# -- seating -------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def log_seatings(d: float, most: int) -> np.ndarray:
    """log of the generalised Stirling numbers: row c, column t, up to `most` customers."""
    table = np.full((most + 1, most + 1), -np.inf)
    table[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, most):
            stay = np.log(np.maximum(c - d * t, 1e-300)) + table[c, 1:]
            table[c + 1, 1:] = np.logaddexp(table[c, :-1], np.where(t <= c, stay, -np.inf))
    return table


# Dishes are drawn together with others of up to so many customers.
WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)


@lru_cache(maxsize=4)
def seating_ratios(d: float) -> np.ndarray:
    """S(c, t + 1) / S(c, t) at [t, c], 0 from t = c on, up to 32 customers."""
    table = log_seatings(d, 32)
    out = np.zeros((33, 33))
    for c in range(2, 33):
        out[1:c, c] = np.exp(np.diff(table[c, 1 : c + 1]))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series above 8, shifted there; x > 0."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_seatings_far(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers: from the generating function ((1 - (1 - x)^d) / d)^t / t!.

    Few tables: the sum over its powers of (1 - x)^d, whose terms fall by t / c^d. Else its saddle point, less
    what that is off at the same t / c^d with 256 customers, where the numbers are known.
    """
    few = t < 0.5 * c**d
    out = np.empty(len(c))
    out[few] = _few_tables(c[few], t[few], d)
    far, same = c[~few], t[~few] * (256 / c[~few]) ** d
    out[~few] = _saddle_point(far, t[~few], d) + np.interp(same, np.arange(1, 225), _saddle_error(d)[:224])
    return out


@lru_cache(maxsize=4)
def _saddle_error(d: float) -> np.ndarray:
    t = np.arange(1.0, 257)
    return log_seatings(d, 256)[256, 1:257] - _saddle_point(np.full(256, 256.0), t, d)


def _few_tables(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    first = log_gamma(c - d) + log_gamma(np.full(len(c), 1 + d))
    total = np.zeros(len(c))
    for j in range(1, 17):
        choose = np.where(t >= j, log_gamma(t + 1) - log_gamma(np.maximum(t - j, 0) + 1) - log_gamma(np.array(j + 1.0)), -np.inf)
        size = choose + log_gamma(np.array(1 + j * d)) + log_gamma(c - j * d) - first
        total += (-1) ** (j + 1) * np.sin(np.pi * j * d) * np.exp(size)
    return np.log(total / np.pi) + first - t * np.log(d) - log_gamma(t + 1.0)


def _saddle_point(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    low, high = np.full(len(c), -700.0), np.zeros(len(c))  # log(1 - x)
    for _ in range(48):
        middle = (low + high) / 2
        ratio = -np.expm1(middle) * np.exp((d - 1) * middle) * d / -np.expm1(d * middle)
        more = ratio > c / t
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    y = (low + high) / 2
    x, h = -np.expm1(y), -np.expm1(d * y) / d
    g = x * np.exp((d - 1) * y) / h
    spread = t * (g + x**2 * (1 - d) * np.exp((d - 2) * y) / h - g**2)
    far = log_gamma(c + 1.0) - log_gamma(t + 1.0) + t * np.log(h) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))
    return np.where(t == c, 0.0, far)


def draw_tables(
    c: np.ndarray, others: np.ndarray, parent: np.ndarray, d: float, settings: Settings, rng: np.random.Generator
) -> np.ndarray:
    """Tables of dishes with c customers, given the other tables of their restaurants and the parent's probabilities."""
    t = np.ones(len(c), np.int64)
    base = settings.strength + d * others
    near = np.flatnonzero((c > 1) & (c <= settings.exact))
    near = near[np.argsort(c[near], kind="stable")]
    edges = np.searchsorted(c[near], [w + 1 for w in WIDTHS])
    for width, a, b in zip(WIDTHS, [0, *edges], edges):
        for begin, end in slices(np.full(b - a, width), 1 << 20):
            some = near[a + begin : a + end]
            own, n, pull = base[some], c[some], parent[some]
            odds = np.empty((width, len(some)))
            if width <= 32:
                # Weights by their ratios: at most 31 factors, which a double can hold.
                ratio = seating_ratios(d)
                odds[0] = 1.0
                for j in range(1, width):
                    odds[j] = odds[j - 1] * ratio[j, n] * ((own + d * j) * pull)
            else:
                log = np.log(own + d * np.arange(width)[:, None]) + np.log(pull)
                log = np.cumsum(log, axis=0) + log_seatings(d, settings.exact)[n, 1 : width + 1].T
                odds = np.exp(log - log.max(axis=0))
            odds = odds.cumsum(axis=0)
            t[some] = 1 + (odds < odds[-1] * rng.random(len(some))).sum(axis=0)
    far = np.flatnonzero(c > settings.exact)
    if len(far):
        n, own, p = c[far], base[far], parent[far]

        def weigh(v: np.ndarray) -> np.ndarray:
            seats = log_gamma(own / d + v) - log_gamma(own / d) + v * np.log(d)
            return log_seatings_far(n, v, d) + seats + v * np.log(p)

        pull = own * p
        start = np.clip(pull * np.log1p(n / pull) + 1, 1, n)
        stride = np.sqrt(start) + 1
        now = np.floor(start).astype(np.int64)
        weight = weigh(now)
        for _ in range(settings.steps):
            moved = now + np.rint(rng.normal(0, 1, len(far)) * stride).astype(np.int64)
            inside = (moved >= 1) & (moved <= n)
            tried = weigh(np.where(inside, moved, now))
            taken = inside & (np.log(1 - rng.random(len(far))) < tried - weight)
            now, weight = np.where(taken, moved, now), np.where(taken, tried, weight)
        t[far] = now
    return t


@dataclass(frozen=True)
class Model:
    """Scalars of the corpus: known words, training tokens, discounts of contexts and root."""

    known: int
    tokens: int
    d: float
    d_root: float
    strength: float

    def parent(self, customers: np.ndarray, tables: np.ndarray, root: tuple[int, int]) -> np.ndarray:
        """P(w) from the root's customers and tables at w and in all."""
        whole, whole_tables = root
        new = (self.strength + self.d_root * whole_tables) / (self.known + 1)
        return (customers - self.d_root * tables + new) / (self.strength + whole)

    def predict(self, c, t, size, size_tables, parent):
        return (c - self.d * t + (self.strength + self.d * size_tables) * parent) / (self.strength + size)


def state_sums(states: DataFrame, parts: int, settings: Settings) -> DataFrame:
    """SUMS of every state row by word: tables of its restaurants, tables that serve it."""
    schema = schema_string(states)

    def run(batches):
        for batch in batches:
            out = Outbox(batch.column(5).type.value_type)
            for to, data in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist()):
                du, w, _, t = unpack(data)
                zero = np.zeros(len(t), np.int64)
                x, tables, dishes = summed(
                    np.concatenate((np.cumsum(du), w)), np.concatenate((t, zero)), np.concatenate((zero, t))
                )
                sent_by_word(out, SUMS, to, parts, settings.row, x, tables, dishes)
            if out.rows:
                yield from out.table().to_batches()

    return in_small_batches(states.select("to", "kind", "sender", "seq", "data", "ids")).mapInArrow(run, schema)


class Restaurants:
    """Sizes of a word part: customers and tables of each word's restaurant; the root's customers and tables."""

    def __init__(self, static: list, sums: list, model: Model, settings: Settings, rng: np.random.Generator):
        fixed = [unpack(m[2]) for m in static]
        moved = [unpack(m[2]) for m in sums]
        rows = [np.cumsum(m[0]) for m in (*fixed, *moved)]
        n = 1 + max((int(r[-1]) for r in rows), default=-1)
        self.size, self.tables, self.customers = (np.zeros(n, np.int64) for _ in range(3))
        for rank, (_, size, tables, dishes) in zip(rows, fixed):
            self.size[rank] += size
            self.tables[rank] += tables
            self.customers[rank] += dishes
        for rank, (_, tables, dishes) in zip(rows[len(fixed) :], moved):
            self.tables[rank] += tables
            self.customers[rank] += dishes
        self.root_tables = np.zeros(n, np.int64)
        some = np.flatnonzero(self.customers)
        if len(some):
            uniform = np.full(len(some), 1 / (model.known + 1))
            others = np.full(len(some), float(model.known))
            self.root_tables[some] = draw_tables(self.customers[some], others, uniform, model.d_root, settings, rng)

    def at(self, rank: np.ndarray) -> list[np.ndarray]:
        """Values of words; words without training tokens have zeros."""
        inside = rank < len(self.size)
        safe = np.where(inside, rank, 0)
        return [np.where(inside, v[safe], 0) if len(v) else np.zeros(len(rank), np.int64) for v in self.columns]

    @property
    def columns(self) -> tuple[np.ndarray, ...]:
        return self.size, self.tables, self.customers, self.root_tables

    def total(self) -> np.ndarray:
        return np.array([self.customers.sum(), self.root_tables.sum()])


def replied(states: DataFrame, static: DataFrame, model: Model, parts: int, turn: int, settings: Settings) -> DataFrame:
    """First half of a round: REPLY rows with the sizes that each state asked for, TOTAL of the root."""

    def weigh(q: int, boxes: dict, out: Outbox) -> None:
        rng = np.random.default_rng([settings.seed, turn, 0, q])
        sizes = Restaurants(boxes[STATIC], boxes[SUMS], model, settings, rng)
        for to, seq, data, _ in boxes[SUMS]:
            x = np.cumsum(unpack(data)[0])
            out.send(to, REPLY, q, pack(steps_of(x), *sizes.at(x)), seq)
        out.send(q, TOTAL, q, pack(sizes.total()))

    return by_receiver(static.unionByName(state_sums(states, parts, settings)), weigh)


def seated(states: DataFrame, replies: DataFrame, model: Model, parts: int, turn: int, settings: Settings) -> DataFrame:
    """Second half: new STATE rows."""
    root = root_of(totals(replies))

    def seat(piece: int, boxes: dict, out: Outbox) -> None:
        (_, _, data, _), = boxes[STATE]
        du, w, c, t = unpack(data)
        u = np.cumsum(du)
        told = [unpack(m[2]) for m in boxes[REPLY]]
        x = np.concatenate([np.cumsum(m[0]) * parts + q for m, (q, *_) in zip(told, boxes[REPLY])])
        order = np.argsort(x)
        x = x[order]
        tables, customers, root_tables = (np.concatenate([m[i] for m in told])[order] for i in (2, 3, 4))
        parent = model.parent(customers, root_tables, root)
        rng = np.random.default_rng([settings.seed, turn, 1, piece])
        at_u, at_w = np.searchsorted(x, u), np.searchsorted(x, w)
        t = draw_tables(c, (tables[at_u] - t).astype(float), parent[at_w], model.d, settings, rng)
        out.send(piece, STATE, 0, pack(du, w, c, t))

    return by_receiver(states.unionByName(replies.filter(F.col("kind") == REPLY)), seat)


def root_of(sums: dict, key: tuple = ()) -> tuple[int, int]:
    """Customers and tables of the root."""
    return tuple(int(v) for v in sums.get(key, (0, 0)))


# -- scores --------------------------------------------------------------------------------------


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens.
    """
    spark = docs.sparkSession
    parts = settings.parts
    if parts is None:
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        parts = max(1, -(-size // settings.part_bytes))
    blocks = stored(tokenised(docs, parts, settings), "blocks")
    texts = blocks.filter(F.col("kind").isin(CODES, DOCS))
    ids = stored(numbered(blocks, parts), "word-numbers")
    known, tokens, once, twice = (int(v) for v in totals(ids).get((), (0, 0, 0, 0)))
    pairs = stored(paired(texts, ids, parts, settings), "pairs")
    counts, counts_path = stored_at(counted(pairs, parts, settings), "pair-counts")
    pairs_once, pairs_twice, _ = totals(counts).get((), (0, 0, 0))
    model = Model(known, tokens, discount(int(pairs_once), int(pairs_twice)), discount(once, twice), settings.strength)
    static = stored(merged_static(counts, settings), "static")
    states, path = counts.filter(F.col("kind") == STATE), counts_path
    kept = []
    for turn in range(settings.burn_in + settings.samples):
        before = path
        replies, replies_path = stored_at(replied(states, static, model, parts, turn, settings), "replies")
        states, path = stored_at(seated(states, replies, model, parts, turn, settings), "states")
        drop_folder(spark, replies_path)
        if turn >= settings.burn_in:
            kept.append(states)
        if turn <= settings.burn_in:
            drop_folder(spark, before)  # not a kept sample, and read for the last time
    return _scored(texts, ids, pairs, static, kept, model, parts, settings, docs)


def block_scores(own: Block, boxes: dict, model: Model, root: list, settings: Settings) -> pa.Table:
    """Results of the texts of a block, from what it was told about its words and pairs."""
    told = [unpack(m[2]) for m in boxes[ROOT]]
    place = own.local_rank[np.concatenate([m[0] for m in told])]

    def by_word(i: int) -> np.ndarray:
        values = np.empty(len(own.number), np.int64)
        values[place] = np.concatenate([m[i] for m in told])
        return values

    pair = np.concatenate([some for _, _, some in own.messages(settings.row)])
    counts = [np.concatenate(c) for c in zip(*(unpack(m[2]) for m in boxes[COUNTS]))]
    left, right = own.left[pair], own.right[pair]
    c = counts[0]
    size = by_word(1)
    odds = np.zeros(len(pair))
    for s, whole in enumerate(root):
        tables, customers, root_tables = (by_word(2 + 3 * s + j) for j in range(3))
        parent = model.parent(customers, root_tables, whole)
        t = np.minimum(c, 1)
        t[c > 1] = counts[1 + s]
        odds += model.predict(c, t, size[left], tables[left], parent[right])
    log = np.empty(len(pair))
    log[pair] = np.log10(odds / len(root))
    starts = np.cumsum(own.lengths) - own.lengths
    base = np.log10((own.seen + 0.1) / (model.tokens + 0.1 * (model.known + 1)))
    return pa.table(
        {
            "doc_id": own.ids,
            "held_out": own.held,
            "n_tokens": own.lengths,
            "n_known": np.add.reduceat((own.seen > 0)[own.word].astype(np.int64), starts),
            "train_tokens": np.full(len(own.lengths), model.tokens),
            "base_score": np.add.reduceat(base[own.word], starts),
            "score": np.add.reduceat(log[own.pair], starts),
        }
    )


def _scored(texts, ids, pairs, static, kept, model: Model, parts: int, settings: Settings, docs: DataFrame) -> DataFrame:
    n_kept = len(kept)
    # What was drawn in sample s is told apart by the kind: STATE and SUMS plus 100 (s + 1).
    marked = [s.withColumn("kind", F.col("kind") + 100 * (i + 1)) for i, s in enumerate(kept)]
    sums = [
        state_sums(s, parts, settings).withColumn("kind", F.col("kind") + 100 * (i + 1)) for i, s in enumerate(kept)
    ]
    asked = ids.filter(F.col("kind") == IDS).withColumns({"to": F.col("sender"), "sender": F.col("to")})

    def sizes(q: int, boxes: dict, out: Outbox) -> None:
        own = []
        for s in range(n_kept):
            rng = np.random.default_rng([settings.seed, s, 2, q])
            own.append(Restaurants(boxes[STATIC], boxes[SUMS + 100 * (s + 1)], model, settings, rng))
            out.send(s, TOTAL, q, pack(own[-1].total()))
        for block, seq, data, _ in boxes[IDS]:
            local, number, _ = unpack(data)
            rank = number // parts
            out.send(block, ROOT, q, pack(local, own[0].at(rank)[0], *(v for o in own for v in o.at(rank)[1:])), seq)

    words = static
    for frame in (*sums, asked):
        words = words.unionByName(frame)
    roots = stored(by_receiver(words, sizes), "word-sizes")
    found = totals(roots, "to")
    root = [root_of(found, (s,)) for s in range(n_kept)]

    def tables(p: int, boxes: dict, out: Outbox) -> None:
        _, _, c, place = gathered(boxes[PAIRS])
        t = np.zeros((n_kept, len(c)), np.int64)
        for s in range(n_kept):
            rows = sorted(boxes[STATE + 100 * (s + 1)])
            if rows:
                t[s, c > 1] = np.concatenate([unpack(m[2])[3] for m in rows])
        at = 0
        for block, seq, data, _ in boxes[PAIRS]:
            own = place[at : at + len(unpack(data)[0])]
            at += len(own)
            often = own[c[own] > 1]
            out.send(block, COUNTS, p, pack(c[own], *(t[s, often] for s in range(n_kept))), seq)

    sent = pairs
    for frame in marked:
        piece = F.col("to").bitwiseAND((1 << 24) - 1).cast("int")
        sent = sent.unionByName(frame.withColumns({"seq": piece, "to": F.shiftright("to", 24)}))
    counts = by_receiver(sent, tables)
    def finish(table: pa.Table) -> pa.Table | None:
        results = []
        deliver(table, lambda _, boxes: results.append(block_scores(Block(boxes, parts), boxes, model, root, settings)))
        return pa.concat_tables(results) if results else None

    kind = docs.schema["doc_id"].dataType.simpleString()
    everything = texts.unionByName(ids.filter(F.col("kind") == IDS)).unionByName(
        roots.filter(F.col("kind") == ROOT)
    ).unionByName(counts)
    return map_units(
        everything,
        "to",
        finish,
        f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )

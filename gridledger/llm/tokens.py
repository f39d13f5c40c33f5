"""Token counts of a public byte-level vocabulary, merged rank by rank over ragged numpy arrays.

Texts are split into pre-tokens; the symbols of all new pre-tokens of a batch lie in one flat
array. In each round every pre-token finds its adjacent pair of lowest rank and merges all
occurrences of that pair, all pre-tokens at once, until no pair of any has a rank. The symbols
left are the tokens. Ranks and initial symbols are read from the vocabulary file, whose path is a
parameter; nothing is trained.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted each;
a special string inside a text is one token, as the library's default has it. Additional columns
are not read.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridledger.llm.common import map_arrow, strings

# The split pattern of byte-level vocabularies in the classes of `re`: exact on ASCII text, and on
# other text as far as its characters have been compared with the library's pre-tokenizer.
QUICK_ASCII = re.compile(
    r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII
)
QUICK = re.compile(r" ?[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
CACHED = 400_000  # pre-tokens whose counts a worker remembers
NONE = np.int64(1 << 40)


def merge_counts(symbols: np.ndarray, first: np.ndarray, pairs: np.ndarray, made: np.ndarray) -> np.ndarray:
    """Number of symbols left of each sequence.

    `first[i]` to `first[i + 1]` delimit sequence i; `pairs` holds left * 2**20 + right of all
    merges sorted by value, `made` their (rank, new symbol) rows.
    """
    symbols = symbols.astype(np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    done = np.zeros(len(first) - 1, np.int64)
    while len(symbols):
        # Rank of the pair that starts at each symbol; none across sequences.
        key = np.full(len(symbols), -1, np.int64)
        same = owner[1:] == owner[:-1]
        key[:-1][same] = (symbols[:-1][same] << 20) | symbols[1:][same]
        at = np.searchsorted(pairs, key)
        at[at == len(pairs)] = 0
        rank = np.where(pairs[at] == key, made[at, 0], NONE)
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.concatenate((starts, [len(symbols)])))
        # Finished sequences leave the arrays.
        ended = best == NONE
        done[owner[starts[ended]]] = sizes[ended]
        alive = np.repeat(~ended, sizes)
        hit = (rank == np.repeat(best, sizes)) & alive
        # Of touching occurrences (a a a) the first, third, .. merge, as from left to right.
        where = np.flatnonzero(hit)
        if len(where):
            run = np.concatenate(([True], np.diff(where) != 1))
            begins = np.flatnonzero(run)
            order = np.arange(len(where)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(where)]))))
            where = where[order % 2 == 0]
            symbols[where] = made[at[where], 1]
            alive[where + 1] = False
        symbols, owner = symbols[alive], owner[alive]
    return done


class Vocabulary:
    """Symbols and merges of a vocabulary file, with the counts of pre-tokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        pairs, made = [], []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append((ids[left] << 20) | ids[right])
            made.append((rank, ids[left + right]))
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs = np.array(pairs, np.int64)[order]
        self.made = np.array(made, np.int64).reshape(-1, 2)[order]
        self.byte_ids = np.zeros(256, np.int64)
        for value, letter in byte_letters().items():
            self.byte_ids[value] = ids[letter]
        special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        special.sort(key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.checked: dict[str, bool] = {}
        self.counts = Counts()

    def _agrees(self, letter: str) -> bool:
        """Whether the quick pattern puts a character into the same class as the library, which
        may know another Unicode version and tells numerals from letters."""
        if letter not in self.checked:
            probe = f"a{letter}b {letter} 1{letter}{letter}x'{letter}"
            own = [m.span() for m in QUICK.finditer(probe)]
            self.checked[letter] = own == [s for _, s in self.library.pre_tokenize_str(probe)]
        return self.checked[letter]

    def pre_tokens(self, text: str) -> list[str]:
        if text.isascii():
            return QUICK_ASCII.findall(text)
        if all(map(self._agrees, set(text))):
            return QUICK.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def count(self, texts: list[str]) -> list[int]:
        """Token counts of whole texts."""
        totals, bounds, counts = [], [0], self.counts
        if len(counts) > CACHED:
            counts.clear()
        met = counts.met = []
        for text in texts:
            parts = [text]
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
            tokens = chain.from_iterable(map(self.pre_tokens, parts))
            totals.append(len(parts) - 1 + sum(map(counts.__getitem__, tokens)))
            bounds.append(len(met))
        if met:
            new = list(set(met))
            coded = [t.encode("utf-8") for t in new]
            first = np.concatenate(([0], np.cumsum([len(b) for b in coded])))
            flat = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
            counts.update(zip(new, merge_counts(flat, first, self.pairs, self.made).tolist()))
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                totals[i] += sum(map(counts.__getitem__, met[a:b]))
        return totals


class Counts(dict):
    """Counts of known pre-tokens; others count 0 for now and are noted in `met`."""

    met: list[str]

    def __missing__(self, token: str) -> int:
        self.met.append(token)
        return 0


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return letters


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


STEP_CHARS = 500_000


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row's whole text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary(path)
        texts = strings(batch.column(1))
        n_tokens: list[int] = []
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > STEP_CHARS or i + 1 == len(texts):
                n_tokens += known.count(texts[begin : i + 1])
                begin, size = i + 1, 0
        counts = pa.array(n_tokens, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                counts,
                pa.array([n > limit for n in n_tokens], pa.bool_()),
            ],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        docs.select("doc_id", "text"),
        work,
        f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean",
    )

"""Benchmark decontamination by winnowing.

Both sides keep the least hash of each sliding window of k-grams.  Where a fingerprint of a document is
one of the benchmark's, the windows of ``span`` words around it are looked up among all windows of the
items, and so the hit is extended to the left and right as far as such windows reach.  A shared span
of ``span`` words holds ``span - k + 1`` k-grams, one of which is kept on both sides, so none is
missed.  Items shorter than ``span`` words are one window each: those are looked up by the hash of all
of their words at every position.

A window leads to the list of the items that have it, and windows with the same items share one list:
a preamble that thousands of items begin with costs a document no more than one that a single item has,
but for the digest of their names, which is made once a task.

The benchmark is read in blocks of bounded bytes (an item over the bound is cut into pieces that
overlap by ``span - 1`` words, which keeps every window).  Up to ``HELD`` blocks are broadcast at a
time, and documents pass through them without a shuffle; a usual benchmark is a single block.

Defined results: null texts and texts without words have no words, no hits and no items; empty
tables work; repeated document rows each keep a row; repeated item rows count as one item, by id;
an item with a null id marks words but isn't listed; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import HELD, each
from .common import blocks, materialize, utf8_views
from .grams import ALNUM, U, Words, gram_at, mix, shingles, winnow, words

#: Bytes of item text in one broadcast block, and of document text that a block is applied to at once.
BLOCK_BYTES = TEXT_BYTES = 16 << 20
#: Words whose fingerprints are taken together.
STRETCH = 1 << 19

_STATE = "n_words long, items array<string>, hits binary"


def fingerprints(w: Words, span: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(hashes, first words)`` of the kept k-grams, some twice."""
    for lo in range(0, len(w.hashes), STRETCH):
        part = slice(lo, lo + STRETCH + span - 1)
        grams, at = shingles(w.hashes[part], w.doc[part], k)
        kept = winnow(grams, at, w.doc[part], span - k + 1)
        yield grams[kept], at[kept] + lo


class Windows:
    """Windows of items by hash, and for each the number of the list of its items."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1]))
        hashes, items = hashes[new], items[new]
        self.hashes, first, count = np.unique(hashes, return_index=True, return_counts=True)
        signs = np.add.reduceat(mix(items.astype(U) + U(1)), first)
        _, one, self.list_of = np.unique(signs, return_index=True, return_inverse=True)
        self.items = np.concatenate([items[first[i] : first[i] + count[i]] for i in one])
        self.bounds = np.append(0, np.cumsum(count[one]))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(whether it is there, list)``."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.list_of[at]


class Index:
    """Fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str]], span: int, k: int):
        self.span, self.k = span, k
        numbers: dict[str | None, int] = {}
        item = np.array([numbers.setdefault(i, len(numbers)) for i, _ in items], np.int64)
        self.names = list(numbers)
        raw = [t.encode() for _, t in items]
        w = words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), ALNUM)
        counts = np.diff(w.bounds)
        prints = [g for g, _ in fingerprints(w, span, k)]
        self.prints = np.unique(np.concatenate(prints)) if prints else np.empty(0, U)
        self.windows: dict[int, Windows] = {}
        for m in range(1, span + 1):
            mine = counts >= span if m == span else counts == m
            if mine.any():
                grams, at = shingles(w.hashes, w.doc, m)
                here = mine[w.doc[at]]
                self.windows[m] = Windows(grams[here], item[w.doc[at[here]]])

    def search(self, w: Words, hit: np.ndarray) -> dict[int, set[tuple[int, int]]]:
        """Marks the hit words; returns the lists, by window size and number, that each document meets."""
        found: dict[int, set] = defaultdict(set)
        ends = np.zeros(len(hit) + 1, np.int32)
        for m, windows in self.windows.items():
            for starts, grams in self._candidates(w, m):
                there, lists = windows.find(grams)
                starts, lists = starts[there], lists[there]
                np.add.at(ends, starts, 1)
                np.add.at(ends, starts + m, -1)
                pairs = np.unique(np.column_stack([w.doc[starts], lists]), axis=0) if len(starts) else ()
                for d, x in pairs:
                    found[int(d)].add((m, int(x)))
            hit |= np.cumsum(ends[:-1]) > 0
            ends[:] = 0
        return found

    def _candidates(self, w: Words, m: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of ``m`` words that may be an item's: around fingerprints, or all if they are too short for these."""
        if m < self.span:
            for lo in range(0, len(w.hashes), STRETCH):
                part = slice(lo, lo + STRETCH + m - 1)
                grams, at = shingles(w.hashes[part], w.doc[part], m)
                yield at + lo, grams
            return
        for prints, at in fingerprints(w, self.span, self.k):
            where = np.minimum(np.searchsorted(self.prints, prints), len(self.prints) - 1)
            met = at[self.prints[where] == prints]
            if len(met):
                starts = np.unique(met[:, None] - np.arange(m - self.k + 1))
                starts = starts[(starts >= 0) & (starts + m <= len(w.doc))]
                starts = starts[w.doc[starts] == w.doc[starts + m - 1]]
                yield starts, gram_at(w.hashes, starts, m)

    def listed(self, lists: set[tuple[int, int]]) -> frozenset[str]:
        found = [self.windows[m].items[self.windows[m].bounds[x] : self.windows[m].bounds[x + 1]] for m, x in lists]
        return frozenset(self.names[i] for i in np.unique(np.concatenate(found))) - {None}


def item_blocks(items: Iterator[tuple[str | None, str | None]], span: int, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, str]]]:
    """Lists of items of at most ``limit`` bytes; a longer item goes into several, overlapping by ``span - 1`` words."""
    block, size = [], 0
    for name, text in items:
        if not text:
            continue
        for piece in [text] if len(text) * 4 <= limit else _pieces(text, span, limit // 4):
            n = len(piece.encode())
            if block and size + n > limit:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += n
    if block:
        yield block


def _pieces(text: str, span: int, limit: int) -> Iterator[str]:
    raw = text.encode()
    w = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    first, n = 0, len(w.starts)
    while first < n:
        last = int(np.searchsorted(w.starts, w.starts[first] + limit))
        last = min(max(last, first + span), n)
        end = len(raw) if last == n else int(w.starts[last])
        yield raw[w.starts[first] : end].decode()
        if last == n:
            return
        first = last - span + 1


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    span: int = 10,
    k: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    held: int = HELD,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``."""
    if not 0 < k <= span:
        raise ValueError("k must be between 1 and span")
    spark = docs.sparkSession
    rows = ((r[0], r[1]) for r in items.select(F.col(item_id_col).cast("string"), F.col(item_text_col).cast("string")).toLocalIterator())
    state = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    # One block at a time is indexed on the driver; a pass has at most ``held`` of them.
    passes = batched(item_blocks(rows, span, block_bytes), held)
    shared = [spark.sparkContext.broadcast(Index(b, span, k)) for b in next(passes, ())]
    while True:
        following = [spark.sparkContext.broadcast(Index(b, span, k)) for b in next(passes, ())]
        state = _pass(state, shared, id_col, last=not following)
        if not following:
            return state
        state, shared = materialize(state, "decontaminate"), following


class _Text:
    """A block of documents on its way through the blocks of a pass."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.words = first, words(raw, offsets, ALNUM)
        self.hit = np.zeros(len(self.words.hashes), bool)
        self.names: dict[int, frozenset] = {}  #: by document


def _pass(state: DataFrame, shared: list[Broadcast], id_col: str, last: bool) -> DataFrame:
    """Documents past the blocks of a pass.  Between passes a row holds its hit words as bits and its items so far."""
    begun = "hits" in state.columns
    id_type = state.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {id_type}, " + ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" if last else f"__text string, {_STATE}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, frozenset] = {}  # names of a set of lists
        digests_of: dict[frozenset, str] = {}

        def kept(table: dict, key, make):
            if key not in table:
                if len(table) >= 1 << 10:
                    table.clear()
                table[key] = make()
            return table[key]

        for b in batches:
            raw, offsets = utf8_views(b.column(1))
            n_words, n_hit, items, digests, bits = [], [], [], [], []
            for top, bottom in blocks(offsets, TEXT_BYTES):
                texts = [_Text(raw[offsets[top + lo] : offsets[top + hi]], offsets[top + lo : top + hi + 1], top + lo) for lo, hi in blocks(offsets[top : bottom + 1])]
                for n, index in enumerate(each(shared)):
                    for t in texts:
                        for d, lists in index.search(t.words, t.hit).items():
                            names = kept(known, (n, frozenset(lists)), lambda: index.listed(lists))
                            t.names[d] = t.names[d] | names if d in t.names else names
                for t in texts:
                    bounds = t.words.bounds
                    for d, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                        names = t.names.get(d, frozenset())
                        marks = t.hit[lo:hi]
                        if begun:
                            marks = marks | np.unpackbits(np.frombuffer(b.column(4)[t.first + d].as_py(), np.uint8), count=hi - lo).astype(bool)
                            names = names.union(b.column(3)[t.first + d].as_py())
                        n_words.append(hi - lo)
                        n_hit.append(int(marks.sum()))
                        if last:
                            items.append(len(names))
                            digests.append(kept(digests_of, names, lambda: hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()))
                        else:
                            items.append(sorted(names))
                            bits.append(np.packbits(marks).tobytes())
            if last:
                columns = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())]
                names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], [id_col, *names])
            else:
                columns = [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(bits, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], [id_col, "__text", "n_words", "items", "hits"])

    return state.mapInArrow(run, out)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

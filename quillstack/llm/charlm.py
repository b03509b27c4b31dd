"""Parts of the character language models: gram counting, sorted hash arrays, tables of scores that pass in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .grams import mix

#: Blocks of a table that one pass over the texts uses.
HELD = 16


class Counter:
    """Counts of 64-bit grams by label, kept compact."""

    def __init__(self):
        self.parts: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.pending: dict[str | None, int] = {}

    def add(self, label: str | None, grams: np.ndarray) -> None:
        keys, n = np.unique(grams, return_counts=True)
        self.parts.setdefault(label, []).append((keys, n))
        self.pending[label] = self.pending.get(label, 0) + len(keys)
        if self.pending[label] > 1 << 21:
            self.parts[label] = [self.total(label)]
            self.pending[label] = 0

    def total(self, label: str | None) -> tuple[np.ndarray, np.ndarray]:
        parts = self.parts[label]
        if len(parts) == 1:
            return parts[0]
        keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


class SortedHashes:
    """Keys as a sorted array of their hashes."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(keys)
        self.order = np.argsort(hashed, kind="stable")
        self.hashes = hashed[self.order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(position, whether it is there)``; positions go with arrays laid out by ``order``."""
        if not len(self.hashes):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        wanted = mix(keys)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return at, self.hashes[at] == wanted


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distinct keys, sum of weights, rows)``."""
    found, at, rows = np.unique(keys, return_inverse=True, return_counts=True)
    return found, np.bincount(at, weights, len(found)), rows


def passes(rows: DataFrame, blocks: int, pack: Callable[[pa.Table], tuple], held: int = HELD) -> Iterator[tuple[list[Broadcast], bool]]:
    """``(blocks of a pass, whether it is the last)``: ``rows`` has a column ``block``, and ``pack`` makes arrays of a block.

    Each block, and so each pass, has a fixed bound; it is the number of passes that grows with the table.
    """
    context = rows.sparkSession.sparkContext
    for first in range(0, blocks, held):
        last = min(first + held, blocks)
        yield [context.broadcast(pack(rows.filter(rows["block"] == b).toArrow())) for b in range(first, last)], last == blocks


def each(shared: list[Broadcast]) -> Iterator[tuple]:
    """The blocks of a pass, of which a worker keeps one at a time in memory."""
    for b in shared:
        yield b.value
        if len(shared) > 1:
            vars(b).pop("_value", None)

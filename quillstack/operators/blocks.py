"""The bigram index as blocks of postings, and its dictionary.

Messages of a month come in order of their keys, in slices of at most ``SLICE``.  A slice gives one block for each
gram and field that occurs in it (field ``''`` is all six together): the keys of the messages that have it, how
often, and how long these messages are, as arrays that Parquet delta-codes, beside the first and last key, the
largest count and the least length.  All blocks of a slice speak of the same messages.  So the messages that
have several grams are found slice by slice, a slice that lacks one is left out before any key is read, and what
a gram adds to a score in a slice has an upper bound without looking into the block.

Grams are counted in numpy: a batch of texts becomes one array of code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import FOLDED

SLICE = 1024
#: Bytes of text that are counted together; a text beyond that is a slice by itself.
TEXT = 1 << 23
ALL = ""
SCHEMA = "gram string, field string, slice long, first long, last long, n long, keys array<long>, tfs array<int>, lengths array<long>, most int, least long, month string"
DICTIONARY = "gram string, field string, messages long, occurrences long"


def _token(c: np.ndarray) -> np.ndarray:
    """Whether code points are of the token class; all that are lie below 2^16."""
    inside = lambda a, b: (c >= ord(a)) & (c <= ord(b))
    return inside("0", "9") | inside("a", "z") | inside("가", "힣") | inside("ㄱ", "ㆎ")


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, counts, len(keys)).astype(np.int64)


def _counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(row << 32 | gram, occurrences)`` of a column of folded texts."""
    text = "".join(texts.fill_null("").to_pylist())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), pc.fill_null(pc.utf8_length(texts), 0).to_numpy())
    good = _token(points)
    at = np.flatnonzero(good[:-1] & good[1:] & (rows[:-1] == rows[1:]))
    keys = (rows[at].astype(np.int64) << 32) | (points[at].astype(np.int64) << 16) | points[at + 1]
    return np.unique(keys, return_counts=True)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of one month each, in ascending order of keys, of ``TEXT`` bytes or one row."""
    keys, months = b.column("rowid").to_numpy(), b.column("month").to_pylist()
    size = np.zeros(len(keys), np.int64)
    for c in FOLDED.values():
        size += pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy()
    start = held = 0
    for i in range(len(keys) + 1):
        if i == len(keys) or i > start and (months[i] != months[start] or keys[i] >= keys[i - 1] or held + size[i] > TEXT):
            if i > start:
                yield b.slice(start, i - start).take(pa.array(np.arange(i - start)[::-1]))
            start, held = i, 0
        if i < len(keys):
            held += size[i]


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ids, lengths, month = b.column("rowid").to_numpy(), b.column("n_grams").to_numpy(), b.column("month")[0].as_py()
    found = {f: _counted(b.column(c)) for f, c in FOLDED.items()}
    found[ALL] = _summed(np.concatenate([k for k, _ in found.values()]), np.concatenate([n for _, n in found.values()]))
    for field, (keys, tf) in found.items():
        if not len(keys):
            continue
        order = np.lexsort((keys >> 32, keys & 0xFFFFFFFF))
        gram, row, tf = keys[order] & 0xFFFFFFFF, keys[order] >> 32, tf[order]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        ends = np.append(starts[1:], len(gram))
        offsets = pa.array(np.append(starts, len(gram)).astype(np.int32))
        lists = lambda values, kind: pa.ListArray.from_arrays(offsets, pa.array(values, kind))
        n = len(starts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([chr(g >> 16) + chr(g & 0xFFFF) for g in gram[starts].tolist()]),
                pa.array([field] * n),
                pa.array(np.full(n, ids[-1])),
                pa.array(ids[row[starts]]),
                pa.array(ids[row[ends - 1]]),
                pa.array(ends - starts),
                lists(ids[row], pa.int64()),
                lists(tf, pa.int32()),
                lists(lengths[row], pa.int64()),
                pa.array(np.maximum.reduceat(tf, starts), pa.int32()),
                pa.array(np.minimum.reduceat(lengths[row], starts)),
                pa.array([month] * n),
            ],
            [x.split()[0] for x in SCHEMA.split(", ")],
        )


def blocks(mails: DataFrame) -> DataFrame:
    """The blocks of ``mails``, whose files hold months in descending order of keys; run it with batches of ``SLICE`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                yield from _blocks(part)

    return mails.select("rowid", "month", "n_grams", *FOLDED.values()).mapInArrow(run, SCHEMA)


def postings(found: DataFrame, *keep: str) -> DataFrame:
    """``(gram, field, rowid, tf)`` of blocks; all six fields together are left out."""
    each = F.explode(F.arrays_zip("keys", "tfs")).alias("x")
    return found.filter(F.col("field") != ALL).select("gram", "field", each, *keep).select("gram", "field", F.col("x.keys").alias("rowid"), F.col("x.tfs").cast("long").alias("tf"), *keep)


def dictionary(found: DataFrame, sign: int = 1) -> DataFrame:
    """How many messages have each gram in each field, and how often; to be added to that of other blocks."""
    occurrences = F.aggregate("tfs", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.groupBy("gram", "field").agg((F.sum("n") * sign).alias("messages"), (F.sum(occurrences) * sign).alias("occurrences"))

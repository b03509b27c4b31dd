"""Words and word shingles as 64-bit hashes, a block of documents at a time, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

U = np.uint64
_WORD_BASE = U(0x9E3779B97F4A7C15 | 1)
_GRAM_BASE = U(0xD6E8FEB86659FD93)

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words: anything but space and \t \n \v \f \r.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of words: digits, letters and all of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


#: Words that are hashed together.
_WORDS_AT_ONCE = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Words(NamedTuple):
    hashes: np.ndarray  #: of every word
    doc: np.ndarray  #: document of every word
    starts: np.ndarray  #: first byte of every word
    bounds: np.ndarray  #: words of document d are bounds[d]:bounds[d + 1]


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """The words of the documents ``raw[offsets[d]:offsets[d + 1]]``, A-Z lower-cased."""
    docs = len(offsets) - 1
    inside = table[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]] - offsets[0]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.empty(0, np.int64)
        return Words(none.astype(U), none, none, np.zeros(docs + 1, np.int64))
    hashes = np.empty(len(starts), U)
    for lo in range(0, len(starts), _WORDS_AT_ONCE):  # so that a very long text takes little more than its words
        mine = starts[lo : lo + _WORDS_AT_ONCE]
        begin, end = int(mine[0]), int(starts[lo + len(mine)]) if lo + len(mine) < len(starts) else len(raw)
        lengths = np.diff(np.append(mine, end))
        at = np.arange(end - begin) - np.repeat(mine - begin, lengths)
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _WORD_BASE, U))
        values = (LOWER[raw[begin:end]].astype(U) + U(1)) * powers[at]
        values[~inside[begin:end]] = 0
        hashes[lo : lo + len(mine)] = mix(np.add.reduceat(values, mine - begin))
    bounds = np.searchsorted(starts, offsets - offsets[0])
    return Words(hashes, np.repeat(np.arange(docs, dtype=np.int32), np.diff(bounds)), starts, bounds)


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, position of the first word)`` of each run of ``k`` words within one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= _GRAM_BASE
        h += hashes[j : n + j]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at] + U(k)), at


def gram_at(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The hashes that ``shingles`` gives the runs of ``k`` words that begin at ``starts``."""
    h = hashes[starts]
    for j in range(1, k):
        h = h * _GRAM_BASE + hashes[starts + j]
    return mix(h + U(k))


def winnow(grams: np.ndarray, at: np.ndarray, doc_of: np.ndarray, window: int) -> np.ndarray:
    """Indexes into ``grams`` of the rightmost least hash of each run of ``window`` grams of a document."""
    n = len(grams) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, where = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        other = grams[j : n + j]
        better = other <= least
        least[better], where[better] = other[better], j
    whole = doc_of[at[:n]] == doc_of[at[window - 1 :]]
    return np.unique((np.arange(n) + where)[whole])

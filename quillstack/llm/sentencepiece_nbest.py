"""SentencePiece encoding and decoding with the N best segmentations.

A text becomes a lattice of vocabulary pieces.  A forward Viterbi pass gives every position the least
cost from the start; read backwards that is the exact cost still to go, so an A-star search from the
end yields segmentations in order of their cost, the best first, and never expands one in vain.

Costs are whole numbers, micro-nats, so sums are exact.  A unigram model's pieces cost their negated
scores.  A BPE model stores merge ranks instead, as negated scores too; by Zipf's law the piece of rank r
costs ``ln(r + 1)``.  So a piece that no merge makes, which models hold at a rank of 10^9 (runs of
spaces), costs twice what the last merged one does.  A character without a piece becomes its byte pieces, which
cost what the last merged rank does.

Long texts: no piece spans a pair of characters that is adjacent in no piece, so the lattice falls
apart there: at every space, and within words at many other places.  Each part is solved by a
forward pass with the two least costs, and words are put together from their parts.  A segmentation
of the text is a choice of a segmentation for each word; among the N best only the ``N - 1`` words
with the least gap between their best two can leave their best, so only those are searched by A-star
and combined.

Order: by cost, then fewer words off their best, then their places and ranks, leftmost first.
Within a word, equal costs come in the order in which the search reaches them, which depends on the
word alone.

Defined results: a null or empty text has one segmentation, without pieces, at cost 0; a text with
fewer than N segmentations has them all; decoding gives the text back, but for U+2581, which the
library itself decodes to a space; repeated rows each keep a row; an empty table gives an empty
result; other columns are ignored or, where asked for, carried along.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
BIG = 1 << 60
#: Ids of the best path (32-bit, little-endian), its cost, the gap to the second, whether the ids decode to the text.
Solved = tuple[bytes, int, int, bool]
ENTRIES = 700_000  #: words that a worker remembers, in each of two generations
ROWS = 64  #: texts whose unknown parts are solved at once; few enough to stay in the processor's cache
CACHED = 32  #: characters of the longest part that is remembered


class _Kept(dict):
    """Results by text.  Long texts are not kept; a full table becomes the old one, from which texts that recur come back."""

    def __init__(self, solve, entries: int):
        self.solve, self.entries, self.old = solve, entries, {}

    def __missing__(self, text: str):
        out = self.old.get(text)
        return self.keep(text, self.solve(text) if out is None else out)

    def keep(self, text: str, out):
        if len(text) <= CACHED:
            self.keep_all({text: out})
        return out

    def keep_all(self, found: dict) -> None:
        """Keeps results of short texts."""
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self.update(found)


class Lattice:
    """The pieces of a model, and segmentations over them."""

    def __init__(self, model_path: str, entries: int):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without a normaliser are supported")
        kinds = type(proto.pieces[0])
        plain = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        bytewise = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        if len(bytewise) != 256:
            raise ValueError("only models with byte pieces are supported")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        if proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM:
            cost = {i: round(-1e6 * s) for i, _, s in plain}
            self.byte_cost = max(cost.values())
        else:
            cost = {i: round(1e6 * math.log(max(-s, 0) + 1)) for i, _, s in plain}
            self.byte_cost = round(1e6 * math.log(len(plain) + 1))
        self.bytewise = bytewise
        #: piece or beginning of one: (id, cost), or (-1, 0) if it is only a beginning
        self.edges: dict[str, tuple[int, int]] = {}
        self.text: dict[int, bytes] = {i: bytes([b]) for b, i in bytewise.items()}
        adjacent = set()
        for i, piece, _ in plain:
            for n in range(1, len(piece)):
                self.edges.setdefault(piece[:n], (-1, 0))
                adjacent.add(piece[n - 1 : n + 1])
            self.edges[piece] = (i, cost[i])
            self.text[i] = piece.replace(SPACE, " ").encode()
        self.adjacent = adjacent
        self.longest = max(map(len, self.edges))
        self._tabulate()
        self.searched: dict[tuple[str, int], list] = {}
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known_parts, self.known = _Kept(self.best, entries // 2), _Kept(self.best_of_word, entries)

    def forget(self) -> None:
        """Drops what has been remembered of words."""
        for kept in (self.known, self.known_parts):
            kept.clear()
            kept.old = {}
        self.searched.clear()

    def _tabulate(self) -> None:
        """The trie of pieces as arrays: state 0 is the root, and sorted ``state * chars + char`` lead to the next."""
        chars = sorted({c for piece in self.edges for c in piece})
        self.char_of = np.full(0x110000, -1, np.int32)
        self.char_of[[ord(c) for c in chars]] = np.arange(len(chars))
        self.chars = len(chars)
        states = {"": 0} | {piece: i for i, piece in enumerate(self.edges, 1)}
        move = np.array([states[p[:-1]] * self.chars + self.char_of[ord(p[-1])] for p in self.edges], np.int64)
        order = np.argsort(move)
        self.moves, self.next_state = move[order], order + 1
        self.pairs = np.unique([self.char_of[ord(a)].astype(np.int64) * self.chars + self.char_of[ord(b)] for a, b in self.adjacent])
        self.state_id = np.array([-1, *(i for i, _ in self.edges.values())], np.int32)
        self.state_cost = np.array([0, *(c for _, c in self.edges.values())], np.int64)

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none."""
        wanted = state * self.chars + char
        at = np.minimum(np.searchsorted(self.moves, wanted), len(self.moves) - 1)
        return np.where((self.moves[at] == wanted) & (char >= 0), self.next_state[at], -1)

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """The units of ``texts``; those that aren't known yet are solved, their parts all at once."""
        units = [self.units(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, old, back, new = self.known, self.known.old, {}, []
        for u in set().union(*units):
            if u not in known:
                if u in old:
                    back[u] = old[u]
                elif len(u) <= CACHED:
                    new.append(u)
        split = self._parts_of(new)
        solved = self._solve({p for parts in split.values() for p in parts})
        for u, parts in split.items():
            back[u] = solved[parts[0]] if len(parts) == 1 else _joined([solved[p] for p in parts])
        known.keep_all(back)
        return units

    def _parts_of(self, words: list[str]) -> dict[str, list[str]]:
        """``parts`` of many words at once."""
        if not words:
            return {}
        ends = np.cumsum([len(w) for w in words])
        char = self.char_of[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)].astype(np.int64)
        pair = char[:-1] * self.chars + char[1:]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        cut = (self.pairs[at] != pair) | (char[:-1] < 0) | (char[1:] < 0)  # before the next character
        cut = np.append(True, cut)
        cut[ends[:-1]] = False
        out = {}
        cuts = np.flatnonzero(cut)[1:]
        owner = np.searchsorted(ends, cuts, "right")
        first = dict(zip(*(x.tolist() for x in np.unique(owner, return_index=True))))
        places, stops, n = cuts.tolist(), ends.tolist(), len(cuts)
        owners = owner.tolist()
        for k, w in enumerate(words):
            x = first.get(k)
            if x is None:
                out[w] = [w]
                continue
            base, a, found = stops[k] - len(w), 0, []
            while x < n and owners[x] == k:
                found.append(w[a : places[x] - base])
                a = places[x] - base
                x += 1
            found.append(w[a:])
            out[w] = found
        return out

    def _solve(self, parts: set[str]) -> dict[str, Solved]:
        """The best paths of parts: those kept, and for the others the forward pass, a position of every part at a time."""
        kept, old, out, new = self.known_parts, self.known_parts.old, {}, []
        for p in parts:
            if p in kept:
                out[p] = kept[p]
            elif p in old:
                out[p] = old[p]
            else:
                new.append(p)
        new.sort(key=len, reverse=True)
        found = dict(zip(new, self._forward_all(new)))
        kept.keep_all(found)
        return out | found

    def _forward_all(self, parts: list[str]) -> list[Solved]:
        """``best`` of every part; longer parts come first."""
        if not parts:
            return []
        lens = np.array([len(p) for p in parts])
        rows, width = len(parts), int(lens[0])
        # By position and part, so that a position's row is contiguous.
        points = np.full((rows, width), -1, np.int64)
        points[np.arange(width) < lens[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        points = np.ascontiguousarray(points.T)
        char = np.where(points >= 0, self.char_of[points], -1)
        one, two = np.full((width + 1, rows), BIG, np.int64), np.full((width + 1, rows), BIG, np.int64)
        back, last = np.zeros((width + 1, rows), np.int8), np.full((width + 1, rows), -1, np.int32)
        one[0] = 0
        alive = np.searchsorted(-lens, -np.arange(width + 1), "right")  # parts of so many characters at least

        def reach(at, i: int, j: int, ids: np.ndarray, cost: np.ndarray) -> None:
            x, o = one[i][at] + cost, one[j][at]
            less = x < o
            two[j][at] = np.minimum(np.minimum(two[j][at], np.maximum(o, x)), two[i][at] + cost)
            one[j][at] = np.minimum(o, x)
            back[j][at] = np.where(less, i, back[j][at])
            last[j][at] = np.where(less, ids, last[j][at])

        for i in range(width):
            n = int(alive[i + 1])
            state = self._step(np.zeros(n, np.int64), char[i, :n])
            bare = (state < 0) | (self.state_id[state] < 0)
            size = 1 + (points[i, :n] > 0x7F) + (points[i, :n] > 0x7FF) + (points[i, :n] > 0xFFFF)
            reach(slice(0, n), i, i + 1, np.where(bare, -1, self.state_id[state]), np.where(bare, size * self.byte_cost, self.state_cost[state]))
            r = np.flatnonzero(state >= 0)
            state = state[r]
            for j in range(i + 2, min(i + self.longest, width) + 1):
                longer = np.searchsorted(r, alive[j])
                r = r[:longer]
                state = self._step(state[:longer], char[j - 1][r])
                there = np.flatnonzero(state >= 0)
                if not len(there):
                    break
                r, state = r[there], state[there]
                ids = self.state_id[state]
                whole = np.flatnonzero(ids >= 0)
                reach(r[whole], i, j, ids[whole], self.state_cost[state[whole]])

        path, at, everyone, bare = np.zeros((rows, width), "<i4"), lens.copy(), np.arange(rows), np.zeros(rows, bool)
        steps, column, going = np.zeros(rows, np.int64), width, everyone
        while len(going):
            column -= 1
            ids = last[at[going], going]
            path[going, column] = ids
            bare[going] |= ids < 0
            steps[going] += 1
            at[going] = back[at[going], going]
            going = going[at[going] > 0]
        raw, end = path.tobytes(), np.arange(1, rows + 1) * width * 4
        least, gap = one[lens, everyone], two[lens, everyone]
        gap = np.where(gap >= BIG, BIG, gap - least)
        each = zip(parts, bare.tolist(), least.tolist(), (end - 4 * steps).tolist(), end.tolist(), gap.tolist())
        return [self.best(p) if b else (raw[lo:hi], x, g, self.spells(raw[lo:hi], p)) for p, b, x, lo, hi, g in each]

    def spells(self, ids: bytes, part: str) -> bool:
        """Whether ids decode to the part."""
        return b"".join(map(self.text.__getitem__, array("i", ids))) == part.replace(SPACE, " ").encode()

    def unknown(self, char: str) -> tuple[tuple[int, ...], int]:
        raw = char.encode()
        return tuple(self.bytewise[b] for b in raw), self.byte_cost * len(raw)

    def parts(self, word: str) -> list[str]:
        """The independent parts of a word."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.adjacent]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def units(self, text: str) -> list[str]:
        """Words with the spaces before them, and the parts of those longer than ``CACHED``; together they spell the text."""
        found = self.words.findall(text)
        if max(map(len, found), default=0) > CACHED:
            found = [u for w in found for u in (self.parts(w) if len(w) > CACHED else (w,))]
        return found

    def forward(self, part: str) -> tuple[list[int], list[int], list[tuple[int, tuple[int, ...]]]]:
        """By position: the least cost, the second least, and the last step of the best path ``(start, ids)``."""
        n, edges = len(part), self.edges
        one, two, back = [BIG] * (n + 1), [BIG] * (n + 1), [(0, ())] * (n + 1)
        one[0] = 0
        for i in range(n):
            a, b = one[i], two[i]
            for j in range(i + 1, n + 1):
                edge = edges.get(part[i:j])
                if edge is None:
                    break
                if edge[0] >= 0:
                    x = a + edge[1]
                    if x < one[j]:
                        two[j], one[j], back[j] = one[j], x, (i, (edge[0],))
                    elif x < two[j]:
                        two[j] = x
                    if b + edge[1] < two[j]:
                        two[j] = b + edge[1]
            edge = edges.get(part[i])
            if edge is None or edge[0] < 0:
                ids, cost = self.unknown(part[i])
                x = a + cost
                if x < one[i + 1]:
                    two[i + 1], one[i + 1], back[i + 1] = one[i + 1], x, (i, ids)
                elif x < two[i + 1]:
                    two[i + 1] = x
                if b + cost < two[i + 1]:
                    two[i + 1] = b + cost
        return one, two, back

    def best(self, part: str) -> Solved:
        """The best path of a part."""
        one, two, back = self.forward(part)
        steps, at = [], len(part)
        while at:
            at, ids = back[at]
            steps.append(ids)
        flat = [i for ids in reversed(steps) for i in ids]
        raw = array("i", flat).tobytes()
        return raw, one[-1], (two[-1] - one[-1] if two[-1] < BIG else BIG), self.spells(raw, part)

    def best_of_word(self, word: str) -> Solved:
        """The same for a word or a part."""
        return _joined([self.known_parts[p] for p in self.parts(word)])

    def search(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """``search_anew``, kept for short parts."""
        if len(part) > CACHED:
            return self.search_anew(part, n)
        if len(self.searched) >= 20_000:
            self.searched.clear()
        if (part, n) not in self.searched:
            self.searched[part, n] = self.search_anew(part, n)
        return self.searched[part, n]

    def search_anew(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best ``(cost, ids)`` of a part: backward A-star with the forward costs as what is still to go."""
        one = self.forward(part)[0]
        into: dict[int, list[tuple[int, tuple[int, ...], int]]] = {}

        def steps(end: int) -> list[tuple[int, tuple[int, ...], int]]:
            if end not in into:
                found = []
                for start in range(max(0, end - self.longest), end):
                    edge = self.edges.get(part[start:end])
                    if edge and edge[0] >= 0:
                        found.append((start, (edge[0],), edge[1]))
                edge = self.edges.get(part[end - 1])
                if edge is None or edge[0] < 0:
                    found.append((end - 1, *self.unknown(part[end - 1])))
                into[end] = found
            return into[end]

        out, pushed = [], 0
        heap = [(one[-1], 0, len(part), 0, None)]
        while heap and len(out) < n:
            total, _, at, spent, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((total, tuple(ids)))
                continue
            for start, ids, cost in steps(at):
                pushed += 1
                heapq.heappush(heap, (spent + cost + one[start], pushed, start, spent + cost, (ids, path)))
        return out

    def n_best(self, text: str, n: int, units: list[str] | None = None) -> list[tuple[int, list[bytes], tuple, bool]]:
        """The ``n`` best segmentations of a text: cost, the ids of each unit, where units leave their best, whether the ids decode to the text.

        A text's ids decode to it if those of each unit decode to the unit, which is tested once a unit.
        """
        if not text:
            return [(0, [], (), True)]
        parts = self.units(self.prefix + text.replace(" ", SPACE)) if units is None else units
        base, costs, gaps, spelled = zip(*map(self.known.__getitem__, parts))
        total, gaps = sum(costs), np.array(gaps)
        if len(gaps) > 4 * n:
            near = np.flatnonzero(gaps <= np.partition(gaps, n - 2)[n - 2]) if n > 1 else np.empty(0, np.int64)
        else:
            near = np.arange(len(gaps))
        near = near[gaps[near] < BIG]
        nearest = np.sort(near[np.argsort(gaps[near], kind="stable")][: n - 1])
        choices: list[tuple[int, int, tuple]] = [(0, 0, ())]
        found: dict[int, list] = {}
        for at in nearest.tolist():
            found[at] = self.search(parts[at], n)
            least = found[at][0][0]
            grown = [(c + cost - least, off + (rank > 0), places + ((at, rank),) * (rank > 0)) for c, off, places in choices for rank, (cost, _) in enumerate(found[at])]
            choices = heapq.nsmallest(n, grown)
        out = []
        decodes = all(spelled)
        for extra, _, places in choices:
            ids, right = base, decodes
            if places:
                ids = list(base)
                for at, rank in places:
                    # The search's first path may differ from the Viterbi one at equal cost; then its rank is left to that.
                    ids[at] = np.array(_others(found[at], base[at])[rank - 1], "<i4").tobytes()
                    right = right and self.spells(ids[at], parts[at])
            out.append((total + extra, ids, places, right))
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode()
        return text[1:] if self.prefix and text[:1] == " " else text


def _joined(solved: list[Solved]) -> Solved:
    """Of independent parts in a row: the second best leaves the best in the part of the least gap."""
    if len(solved) == 1:
        return solved[0]
    ids, costs, gaps, spelled = zip(*solved)
    return b"".join(ids), sum(costs), min(gaps), all(spelled)


def _others(found: list[tuple[int, tuple[int, ...]]], best: bytes) -> list[tuple[int, ...]]:
    """A part's segmentations after its best."""
    rest = [ids for _, ids in found if np.array(ids, "<i4").tobytes() != best]
    return rest if len(rest) < len(found) else rest[: len(found) - 1]


@cache
def lattice(model_path: str, entries: int) -> Lattice:
    """One lattice for each process; tasks that follow one another in a worker share it."""
    return Lattice(model_path, entries)


#: What an encoding adds to a row.
COLUMNS = ["n_pieces", "costs", "ids_sha256", "decodes", "ids"]


def encode(docs: DataFrame, model_path: str, n: int, *keep: Column | str, with_ids: bool = False, text_col: str = "text", entries: int = ENTRIES, forget: bool = False) -> DataFrame:
    """Columns ``keep`` with ``n_pieces``, ``costs``, ``ids_sha256`` (both best first), ``decodes`` and, if asked for, ``ids`` of the best.

    ``decodes`` tells whether the ids of every segmentation decode to the text.  A digest is the
    SHA-256 of the ids as 32-bit little-endian integers.  A worker remembers up to twice ``entries``
    words, about 300 bytes each, for its next tasks, or with ``forget`` until its task ends: where other
    stages share the workers' memory.
    """
    chosen = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    extra = "n_pieces long, costs array<bigint>, ids_sha256 array<string>, decodes boolean" + ", ids array<int>" * with_ids
    names = [x.split()[0] for x in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path, entries)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                rows = [_encoded(lat, t, n, u) for t, u in zip(texts, lat.prepare(texts))]
                columns = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([r[3] for r in rows], pa.bool_()),
                ]
                if with_ids:
                    ends = np.cumsum([0, *(len(r[4]) for r in rows)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[4] for r in rows]) if rows else np.empty(0, np.int32))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*b.schema.names[:-1], *names])
        if forget:
            lat.forget()

    return chosen.mapInArrow(run, f"{schema}, {extra}" if schema else extra)


def _encoded(lat: Lattice, text: str, n: int, units: list[str] | None = None) -> tuple[int, list[int], list[str], bool, np.ndarray]:
    found = lat.n_best(text, n, units)
    joined = [b"".join(ids) for _, ids, _, _ in found]
    best = np.frombuffer(joined[0], "<i4")
    return len(best), [f[0] for f in found], [hashlib.sha256(x).hexdigest() for x in joined], all(f[3] for f in found), best


def decode(encoded: DataFrame, model_path: str, *keep: Column | str, ids_col: str = "ids") -> DataFrame:
    """Columns ``keep`` with ``text``, from arrays of ids; null ids give a null text."""
    chosen = encoded.select(*keep, F.col(ids_col).cast("array<int>").alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_path, ENTRIES)
        for b in batches:
            texts = [lat.decode(np.array(x.as_py(), "<i4")) if x.is_valid else None for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    return chosen.mapInArrow(run, f"{schema}, text string" if schema else "text string")


N_BEST = 4


def op4_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), N_BEST, "doc_id")

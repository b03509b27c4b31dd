"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, runs of anything but letters and marks become one space, and every symbol is
predicted from the three before it.  Each task counts its own 4-grams, and Spark adds them up by
language and gram, so counts, continuation counts and discounts are those of all training rows, and
no gram of any language is left out.

The models are never in one place.  The unigrams of all languages (65,536 symbols at most) are
broadcast, bigrams are dealt out by their first symbol, and 4-grams by their two middle ones, so that
each task has whole contexts.  This gives a table with the log-probability of every 4-gram, also of
those that only texts to be judged have, in every language.  Texts pass through that table in
broadcast blocks of about ``block_cells`` numbers in sorted hash arrays, ``HELD`` blocks a pass.

A text goes to the language of the least cross-entropy per symbol.  ``rejected`` marks texts that no
model explains: the least cross-entropy lies more than ``FLOOR`` nats, and more than ``LIMIT`` times
the usual deviation at that length, above what texts of that language usually have.  Both are medians
over all training rows, so that junk among them does not move the limit unless it is most of them.

Defined results: null texts and texts without a letter give ``und`` with score 0, rejected; without
any labelled training row all texts do; a tie goes to the first language in code-point order;
repeated rows each keep a row; an empty table gives an empty result; other columns are ignored.  More
than ``MAX_LANGS`` languages are an error, for then the column holds something else.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import HELD, Counter, SortedHashes, each, passes
from .common import materialize
from .grams import U

ORDER = 4
SPACE = 32
#: Numbers (grams times languages) of a broadcast block, and of a task that builds models.
BLOCK_CELLS, TASK_CELLS = 1 << 22, 1 << 21
MAX_LANGS = 4096
UNKNOWN = "und"
SHARPNESS = 5.0  #: of the softmax that turns cross-entropies into a score
FLOOR = 1.0  #: nats per symbol above the median that a rejected text has at least
LIMIT = 8.0  #: standard deviations, as estimated from the median one, that a rejected text lies above the median at least


@cache
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its 16-bit symbol (space for all but letters and marks), and whether it is a letter.

    Letters beyond the first plane share the private area, which no text letter uses.
    """
    points = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    major = np.array([unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)])
    folded = np.where(points < 0x10000, points, (points & 0x0FFF) | 0xE000)
    return np.where(np.isin(major, ["L", "M"]), folded, SPACE).astype(np.uint16), major == "L"


def symbols(texts: list[str | None], first: bool = True, last: bool = True, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(symbols of all texts, bounds by text, whether a text has a letter)``; each text begins and ends in a space.

    A piece of a longer text is not the ``first`` or not the ``last`` one, and has the symbols ``before`` it.
    """
    left, right = " " * first, " " * last
    lowered = [f"{left}{(t or '').lower()}{right}" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.cumsum([0, *map(len, lowered)])
    table, letters = _symbols()
    s, is_letter = table[points], letters[points]
    kept = np.ones(len(s), bool)
    kept[1:] = (s[1:] != SPACE) | (s[:-1] != SPACE)
    if first:
        kept[bounds[:-1]] = True  # a text's own first space
    elif len(s) and before is not None and before[-1] == SPACE:
        kept[0] = s[0] != SPACE
    has = np.add.reduceat(is_letter, bounds[:-1]) > 0 if len(s) else np.zeros(len(texts), bool)
    return s[kept], np.append(0, np.cumsum(kept))[bounds], has


def grams(s: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(4-grams, bounds by text)``: one for each symbol after a text's first space; before that stand spaces."""
    wide = s.astype(U)
    out = wide.copy()
    at = np.arange(len(s)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, ORDER):
        earlier = np.full(len(s), SPACE, U)
        earlier[back:] = wide[:-back] if len(s) > back else earlier[back:]
        earlier[at < back] = SPACE
        out |= earlier << U(16 * back)
    return out[at > 0], bounds - np.arange(len(bounds))


class Stretch(NamedTuple):
    """The grams of some rows of a batch, or of a piece of one long text."""

    first: int  #: row
    keys: np.ndarray
    ends: np.ndarray  #: bounds of each row's grams
    has: np.ndarray  #: whether there is a letter


def stretches(texts: list[str | None], chars: int = 1 << 18) -> Iterator[Stretch]:
    """The grams of ``texts`` about ``chars`` characters at a time, whole texts together and longer ones in pieces."""
    start, size = 0, 0
    for i, t in enumerate([*texts, None]):
        n = len(t or "")
        if i > start and (size + n > chars or i == len(texts)):
            s, bounds, has = symbols(texts[start:i])
            yield Stretch(start, *grams(s, bounds), has)
            start, size = i, 0
        if n > chars:
            before = None
            for at in range(0, n, chars):
                s, _, has = symbols([t[at : at + chars]], at == 0, at + chars >= n, before)
                joined = s if before is None else np.concatenate([before, s])
                keys, _ = grams(joined, np.array([0, len(joined)]))
                keys = keys[len(joined) - len(s) - 1 :] if before is not None else keys  # those of this piece
                yield Stretch(i, keys, np.array([0, len(keys)]), has)
                before = joined[1 - ORDER :]
            start = i + 1
            continue
        size += n


def _count(rows: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` of ``rows(text, lang)``; a null language counts as one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            langs = np.array(b.column(1).to_pylist(), dtype=object)
            for x in stretches(b.column(0).to_pylist()):
                label = langs[x.first : x.first + len(x.has)]
                rows_of = np.repeat(np.arange(len(x.has)), np.diff(x.ends))
                for lang in set(label.tolist()):
                    counter.add(lang, x.keys[(label == lang)[rows_of]])
        for lang in counter.parts:
            keys, n = counter.total(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame, langs: int) -> np.ndarray:
    """The discount of each language from how many grams occur once and twice."""
    seen = np.zeros((langs, 3))
    for r in counts.filter("n <= 2").groupBy("lang", "n").agg(F.count("*").alias("grams")).collect():  # two rows a language at most
        seen[r["lang"], r["n"]] = r["grams"]
    return np.where((seen[:, 1] > 0) & (seen[:, 2] > 0), seen[:, 1] / np.maximum(seen[:, 1] + 2 * seen[:, 2], 1), 0.5)


def _dense(lists: pa.ChunkedArray, langs: int) -> np.ndarray:
    """Counts by row and language from lists of ``(lang, n)``."""
    lists = lists.combine_chunks()
    out, pairs = np.zeros((len(lists), langs)), lists.flatten()
    out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), pairs.field("lang").to_numpy()] = pairs.field("n").to_numpy()
    return out


def _interpolated(keys: np.ndarray, counts: np.ndarray, discount: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities of ``keys`` (each once, with all keys of its context) by language, given those of the order below."""
    stem, at = np.unique(keys >> U(16), return_inverse=True)
    total, kinds = np.zeros((2, len(stem), counts.shape[1]))
    np.add.at(total, at, counts)
    np.add.at(kinds, at, counts > 0)
    total, kinds = total[at], kinds[at]
    return np.where(total > 0, (np.maximum(counts - discount, 0) + discount * kinds * lower) / np.maximum(total, 1), lower)


def _by_lang(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each of ``keys`` with its list of ``(lang, n)``, of one row a language; null languages are left out."""
    return df.groupBy(*keys).agg(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "n"))).alias("counts"))


class Model(NamedTuple):
    langs: list[str]
    uniform: float  #: log-probability of a symbol without any model
    table: DataFrame  #: ``(gram, logp, block)``, with a number for each language
    blocks: int


def train(labelled: DataFrame, others: DataFrame | None = None, block_cells: int = BLOCK_CELLS, task_cells: int = TASK_CELLS) -> Model | None:
    """Models from all rows of ``labelled(text, lang)``, for these and for ``others(text)``; None without a text that has a language and a letter."""
    spark = labelled.sparkSession
    rows = labelled.select("text", "lang").filter("text is not null and lang is not null")
    if others is not None:
        rows = rows.unionByName(others.select("text", F.lit(None).cast("string").alias("lang")))
    lettered = F.col("text").rlike(r"[\p{L}]")  # texts of other characters only teach nothing
    counts = materialize(_count(rows.withColumn("lang", F.when(lettered, F.col("lang")))), "gram-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGS + 2).collect() if r[0] is not None)
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not langs:
        return None
    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(langs)], "lang string, number int")
    counts = counts.join(F.broadcast(numbers), "lang", "left").select(F.col("number").alias("lang"), "gram", "n")  # MAX_LANGS rows
    known = counts.filter("lang is not null")
    suffix = lambda symbols: F.col("gram").bitwiseAND(F.lit((1 << 16 * symbols) - 1)).alias("gram")
    three = materialize(known.groupBy("lang", suffix(3)).agg(F.count("*").alias("n")), "grams-of-three")  # how many symbols stand before
    two = materialize(three.groupBy("lang", suffix(2)).agg(F.count("*").alias("n")), "grams-of-two")
    one = two.groupBy("lang", suffix(1)).agg(F.count("*").alias("n"))
    d4, d3, d2, d1 = (_discounts(x, len(langs)) for x in (known, three, two, one))

    unigrams = _by_lang(one, "gram").toArrow()  # 65,536 rows at most
    seen = unigrams["gram"].to_numpy().view(U)
    order = np.argsort(seen)
    uniform = 1 / (len(seen) + 1)
    p1 = _interpolated(seen, _dense(unigrams["counts"], len(langs)), d1, np.full((len(seen), len(langs)), uniform))[order]
    rest = np.append(seen, U(0xFFFF))  # a symbol of no training text
    p0 = _interpolated(rest, np.vstack([_dense(unigrams["counts"], len(langs)), np.zeros(len(langs))]), d1, np.full((len(rest), len(langs)), uniform))[-1]
    shared = spark.sparkContext.broadcast((seen[order], p1, p0))
    n_langs = len(langs)

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            table, (symbol, p1, p0) = pa.Table.from_batches(parts), shared.value
            keys = table["pair"].to_numpy().view(U)
            at = np.minimum(np.searchsorted(symbol, keys & U(0xFFFF)), len(symbol) - 1)
            lower = np.where((symbol[at] == keys & U(0xFFFF))[:, None], p1[at], p0)
            yield from _batches("pair", keys, _interpolated(keys, _dense(table["counts"], n_langs), d2, lower), "lower", pa.float64())

    def fourgrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            table = pa.Table.from_batches(parts)
            keys, counts = table["gram"].to_numpy().view(U), _dense(table["counts"], n_langs)
            tail, first, at = np.unique(keys & U((1 << 48) - 1), return_index=True, return_inverse=True)
            before = np.zeros((len(tail), n_langs))
            np.add.at(before, at, counts > 0)
            lower = table["lower"].combine_chunks().flatten().to_numpy().reshape(-1, n_langs)
            p3 = _interpolated(tail, before, d3, lower[first])
            yield from _batches("gram", keys, np.log(_interpolated(keys, counts, d4, p3[at])), "logp", pa.float32())

    middle = lambda c, shift, bits: F.shiftright(c, shift).bitwiseAND(F.lit((1 << bits) - 1))
    size = counts.count() * n_langs
    pairs = two.withColumnRenamed("gram", "pair").unionByName(counts.filter("lang is null").select(F.lit(None).cast("int").alias("lang"), suffix(2).alias("pair"), F.lit(None).cast("long").alias("n")).distinct())
    tasks = lambda cells: math.ceil(cells / task_cells) or 1
    p2 = _by_lang(pairs, "pair").repartition(tasks(size // 8), middle("pair", 16, 16)).mapInArrow(bigrams, "pair long, lower array<double>")
    # Written first, so that the join has a shuffle on either side and a frequent pair can be split.
    whole = _by_lang(counts, "gram").withColumn("pair", F.col("gram").bitwiseAND(F.lit((1 << 32) - 1))).join(materialize(p2, "grams-of-two"), "pair")
    table = whole.select("gram", "counts", "lower").repartition(tasks(size), middle("gram", 16, 32)).mapInArrow(fourgrams, "gram long, logp array<float>")
    blocks = math.ceil(size / block_cells) or 1
    table = table.withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(blocks)))
    return Model(langs, math.log(uniform), materialize(table, "gram-models"), blocks)


def _batches(name: str, keys: np.ndarray, values: np.ndarray, column: str, kind: pa.DataType, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    width = values.shape[1]
    for at in range(0, len(keys), rows):
        part = values[at : at + rows]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, width, dtype=np.int32)), pa.array(part.ravel(), kind, safe=False))
        yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + rows].view(np.int64)), lists], [name, column])


def _pack(n_langs: int):
    def pack(table: pa.Table) -> tuple[SortedHashes, np.ndarray]:
        hashes = SortedHashes(table["gram"].to_numpy().view(U))
        values = table["logp"].combine_chunks().flatten().to_numpy().reshape(-1, n_langs)
        return hashes, values[hashes.order]

    return pack


def cross_entropies(texts: list[str | None], blocks: list, n_langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sum of log-probabilities by text and language, symbols, whether a text has a letter)`` over the blocks of a pass."""
    sums, n, has = np.zeros((len(texts), n_langs)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    waiting: list[Stretch] = []

    def add() -> None:
        for hashes, logp in each(blocks):
            for x in waiting:
                at, there = hashes.find(x.keys)
                score = logp[at] if len(logp) else np.zeros((len(at), n_langs), np.float32)
                score[~there] = 0
                filled = np.flatnonzero(np.diff(x.ends))
                if len(filled):
                    sums[x.first + filled] += np.add.reduceat(score, x.ends[filled], axis=0, dtype=np.float64)
        waiting.clear()

    for x in stretches(texts):
        rows = slice(x.first, x.first + len(x.has))
        n[rows] += np.diff(x.ends)
        has[rows] |= x.has
        waiting.append(x)
        if len(blocks) == 1 or sum(len(w.keys) for w in waiting) > 1 << 20:
            add()
    add()
    return sums, n, has


def score(docs: DataFrame, model: Model | None, *keep: Column | str, text_col: str = "text", held: int = HELD) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``lang_pred``, ``score``, and the ``nats`` per symbol of so many ``symbols``."""
    chosen = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    if model is None:
        return chosen.drop("__text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "nats": F.lit(None).cast("double"), "symbols": F.lit(0).cast("long")})
    langs, kept = model.langs, len(chosen.columns) - 1
    for shared, last in passes(model.table, model.blocks, _pack(len(langs)), held):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sums, n, has = cross_entropies(b.column(kept).to_pylist(), shared, len(langs))
                if b.num_columns > kept + 1:  # what earlier passes have found
                    sums += b.column(kept + 1).flatten().to_numpy().reshape(sums.shape)
                if not last:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, len(langs), dtype=np.int32)), pa.array(sums.ravel()))
                    yield pa.RecordBatch.from_arrays([*b.columns[: kept + 1], lists], [*b.schema.names[: kept + 1], "__sums"])
                    continue
                entropy = -sums / np.maximum(n, 1)[:, None]
                best = entropy.argmin(axis=1)
                least = entropy[np.arange(len(n)), best]
                p = np.where(has, 1 / np.exp(-SHARPNESS * (entropy - least[:, None])).sum(axis=1), 0.0)
                found = [langs[c] if h else UNKNOWN for c, h in zip(best, has)]
                new = [pa.array(found, pa.string()), pa.array(p), pa.array(least, mask=~has), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*b.columns[:kept], *new], [*b.schema.names[:kept], "lang_pred", "score", "nats", "symbols"])

        chosen = chosen.mapInArrow(run, f"{schema}lang_pred string, score double, nats double, symbols long" if last else f"{schema}__text string, __sums array<double>")
        if not last:
            chosen = materialize(chosen, "language-sums")
    return chosen


def _medians(df: DataFrame, step: Column) -> dict[str, int]:
    """The median of the whole number ``step`` by ``lang_pred``, from a histogram over all rows."""
    out: dict[str, list] = {}
    for r in df.groupBy("lang_pred", step.alias("s")).agg(F.count("*").alias("n")).collect():  # a few thousand steps a language
        out.setdefault(r["lang_pred"], []).append((r["s"], r["n"]))
    medians = {}
    for lang, bins in out.items():
        bins.sort()
        upto = np.cumsum([n for _, n in bins])
        medians[lang] = bins[int(np.searchsorted(upto, upto[-1] / 2))][0]
    return medians


def with_rejection(scored: DataFrame, training: Column) -> DataFrame:
    """``scored`` with ``rejected``, by what is usual in the rows of ``training``."""
    seen = scored.filter(training & F.col("nats").isNotNull())
    usual = {x: (s + 0.5) / 200 for x, s in _medians(seen, F.floor(F.col("nats") * 200)).items()}
    frame = lambda rows, columns: F.broadcast(scored.sparkSession.createDataFrame(list(rows), columns))  # noqa: E731  # MAX_LANGS rows
    away = lambda df: df.join(frame(usual.items(), "lang_pred string, usual double"), "lang_pred", "left").withColumn("above", F.col("nats") - F.col("usual"))
    size = F.abs("above") * F.sqrt("symbols")
    steps = _medians(away(seen), F.floor(F.log2(size + 1e-6) * 16))
    spread = {x: max(2 ** ((s + 0.5) / 16) * 1.4826, 1e-6) for x, s in steps.items()}
    judged = away(scored).join(frame(spread.items(), "lang_pred string, spread double"), "lang_pred", "left")
    odd = (F.col("above") > FLOOR) & (F.col("above") * F.sqrt("symbols") > LIMIT * F.col("spread"))
    return judged.select(*scored.columns, (F.col("nats").isNull() | F.coalesce(odd, F.lit(False))).alias("rejected"))


def identify(docs: DataFrame, *keep: Column | str, training: Column | None = None, text_col: str = "text", lang_col: str = "lang", **sizes: int) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` with ``lang_pred``, ``score``, ``nats``, ``symbols`` and ``rejected``.

    The models come from the rows of ``training`` (default: all) that have a text and a language.
    """
    known = F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()
    teaches = F.coalesce(known if training is None else training & known, F.lit(False))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), teaches.alias("teaches"))
    model = train(rows.filter("teaches"), rows.filter("not teaches"), **sizes)
    scored = materialize(score(docs, model, *keep, teaches.alias("__teaches"), text_col=text_col), "languages")
    return with_rejection(scored, F.col("__teaches")).drop("__teaches")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of training: CRC-32 of the id as text, modulo 5, is 0.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, "doc_id", held_out().alias("held_out"), training=~held_out())

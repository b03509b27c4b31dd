"""Substring removal by MinHash banding of paragraphs.

A text is seen at two levels.  A *line* of ``MIN_WORDS`` words or more is a paragraph: its five-word
shingles give a signature, cut into bands of two minima; five bands give pairs at similarity 0.8 a
recall of 0.994, and more above (see ``recall``).  Lines that collide in a band are joined list by
list as in ``minhash_join``, confirmed by exact Jaccard similarity on full sets, and grouped into
components.  A *piece* runs across lines, from one word to the next whose pair with its follower has
the least hash within ``REACH`` words on either side: so the words themselves say where pieces end,
and a passage that stands in the midst of other text, or in short lines, falls into the same pieces
in every document but for its first and last.  Pieces are short, so they are one paragraph only if
they are equal; at 0.8 a changed word would part them anyway.

In each component the first occurrence, by id and place, is kept; the others are removals.  A
component counts only if it spans two documents, and only within runs of neighbours at its level
(``GAP``) of together at least ``MIN_RUN`` words, or four fifths of their text, however short that is: other
short ones are phrases and boilerplate that documents share without being copies.  Lines that many documents share at any length are ``repeated_lines``, an exact
join by digest.

The first pass sends eight-byte hashes only, each once a block of text.  The second pass, with a
bitmap of fixed size to pick them out, sends the paragraphs that collide.

Defined results: rows equal in id and text are one document; null and empty texts, and texts under
``MIN_WORDS`` words, have no paragraphs; a null id is greater than any other; without repeats, or for
an empty table, the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch_rows, blocks, discard, materialize, quoted, release_shuffles, utf8_views
from .grams import NON_SPACE, U, Words, gram_at, mix, words
from .minhash_join import merge_lists, signatures

K, BANDS, ROWS, PERCENT = 5, 5, 2, 80
REACH, MIN_WORDS, MIN_RUN = 4, 5, 20
GAP = 2  #: places from one paragraph of a run to the next at most: one that differs may lie between
BITMAP_BITS = 24
BATCH_ROWS = 1000  #: rows that go to Python at once
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The share of pairs of that similarity that collide in a band at least."""
    return 1 - (1 - similarity**rows) ** bands


class Level(NamedTuple):
    """The paragraphs of one level in a block of documents."""

    doc: np.ndarray
    place: np.ndarray  #: number within its document
    first: np.ndarray  #: first word
    last: np.ndarray  #: word after the last
    name: np.ndarray  #: 64-bit hash of the words, of which the lowest bit tells the level
    second: np.ndarray  #: another one


class Block(NamedTuple):
    starts: np.ndarray  #: first byte of every word
    ends: np.ndarray  #: byte after its last
    lines: Level
    pieces: Level
    flat: np.ndarray  #: shingles of all lines
    bounds: np.ndarray  #: of each line within ``flat``


#: Paragraphs that are named together, so that a very long text takes little more than its words.
_AT_ONCE = 1 << 15
_SALTS = mix(np.arange(1, 4, dtype=U))


def _level(w: Words, cut: np.ndarray, bit: int) -> Level:
    """The paragraphs that end where ``cut`` says, but for those under ``MIN_WORDS`` words."""
    after = np.flatnonzero(cut) + 1
    first = np.append(0, after[:-1])[: len(after)]
    long = after - first >= MIN_WORDS
    first, after = first[long], after[long]
    doc = w.doc[first]
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    place = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0)) if len(doc) else np.empty(0, np.int64)
    sums = np.empty((2, len(first)), U)
    for lo in range(0, len(first), _AT_ONCE):
        count = (after - first)[lo : lo + _AT_ONCE]
        begins = np.append(0, np.cumsum(count))
        within = np.arange(begins[-1]) - np.repeat(begins[:-1], count)
        own = w.hashes[within + np.repeat(first[lo : lo + _AT_ONCE], count)]
        for side, salt in enumerate(_SALTS[:2]):
            sums[side, lo : lo + _AT_ONCE] = np.add.reduceat(mix((own ^ salt) + within.astype(U) * _SALTS[2]), begins[:-1])
    return Level(doc, place, first, after, (mix(sums[0]) & ~U(1)) | U(bit), mix(sums[1]))


def paragraphs(raw: np.ndarray, offsets: np.ndarray) -> Block:
    """Both levels of the documents ``raw[offsets[d]:offsets[d + 1]]``."""
    offsets = offsets - offsets[0]
    w = words(raw, offsets, NON_SPACE)
    n = len(w.starts)
    final = NON_SPACE[raw]
    final[:-1] &= ~NON_SPACE[raw[1:]]
    final[offsets[1:][offsets[1:] > 0] - 1] = NON_SPACE[raw[offsets[1:][offsets[1:] > 0] - 1]]
    ends = np.flatnonzero(final) + 1
    line = np.searchsorted(np.flatnonzero(raw == 10), w.starts)
    cut = np.ones(n, bool)
    cut[:-1] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
    lines = _level(w, cut, 0)
    del line

    same = w.doc[1:] == w.doc[:-1]
    pair = np.full(n, ~U(0))
    for lo in range(0, n - 1, 1 << 18):
        pair[lo : min(lo + (1 << 18), n - 1)] = mix(w.hashes[lo : n - 1][: 1 << 18] * U(3) + w.hashes[lo + 1 :][: 1 << 18])
    pair[:-1][~same] = ~U(0)
    cut = np.ones(n, bool)
    for j in range(1, min(REACH + 1, n)):  # of equal hashes the last is the least
        apart = w.doc[j:] != w.doc[:-j]
        cut[j:] &= apart | (pair[j:] <= pair[:-j])
        cut[:-j] &= apart | (pair[:-j] < pair[j:])
    cut[:-1] |= ~same
    cut[-1:] = True
    pieces = _level(w, cut, 1)

    count = lines.last - lines.first - K + 1
    bounds = np.append(0, np.cumsum(count))
    begins = np.arange(bounds[-1]) + np.repeat(lines.first - bounds[:-1], count)
    flat = gram_at(w.hashes, begins, K)
    return Block(w.starts, ends, lines, pieces, flat, bounds)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key for each band; the low six bits tell the band."""
    wide = sig.view(np.uint32).astype(U).reshape(len(sig), BANDS, ROWS)
    key = np.zeros((len(sig), BANDS), U)
    for r in range(ROWS):
        key = mix(key + wide[:, :, r] + U(r + 1))
    return ((key << U(6)) | np.arange(BANDS, dtype=U)).view(np.int64)


def _collisions(docs: DataFrame) -> DataFrame:
    """``name`` of every piece that occurs twice, and of every line that does or collides with another in a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8_views(b.column(0))
            for start, end in blocks(offsets, 1 << 23):
                names, copies, keys = [], [], []
                for lo, hi in blocks(offsets[start : end + 1]):
                    p = paragraphs(raw[offsets[start + lo] : offsets[start + hi]], offsets[start + lo : start + hi + 1])
                    for level in (p.lines, p.pieces):
                        if len(level.name):
                            name, at, n = np.unique(level.name, return_index=True, return_counts=True)
                            names.append(name)
                            copies.append(n)
                            keys.append(band_keys(signatures(p.flat, p.bounds, BANDS * ROWS))[at] if level is p.lines else None)
                for piece in (False, True):
                    mine = [i for i, k in enumerate(keys) if (k is None) == piece]
                    if mine:
                        name, at, back = np.unique(np.concatenate([names[i] for i in mine]), return_index=True, return_inverse=True)
                        n, name = np.bincount(back, np.concatenate([copies[i] for i in mine])).astype(np.int64), name.view(np.int64)
                        key, times = (name, 1) if piece else (np.concatenate([keys[i] for i in mine])[at].ravel(), BANDS)
                        yield pa.RecordBatch.from_arrays([pa.array([piece] * len(key), pa.bool_()), pa.array(key), pa.array(np.repeat(name, times)), pa.array(np.repeat(n, times))], ["piece", "key", "name", "copies"])

    posted = materialize(docs.select("text").mapInArrow(run, "piece boolean, key long, name long, copies long"), "posted")
    pieces = posted.filter("piece").groupBy("name").agg(F.sum("copies").alias("n")).filter("n > 1").select("name")
    lines = posted.filter("not piece")
    met = lines.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.sum("copies").alias("n")).filter("lo <> hi or n > 1").select("key")
    wanted = materialize(pieces.union(lines.join(met, "key", "left_semi").select("name").distinct()), "paragraph-names")
    discard(posted)
    return wanted


def _occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every paragraph whose name is in ``wanted``, with its place and class, and a line also with its shingles."""
    spark = docs.sparkSession
    slot = F.pmod("name", F.lit(1 << BITMAP_BITS))
    bits = wanted.select(slot.alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("m"))
    words_of = np.zeros(1 << (BITMAP_BITS - 5), np.uint32)
    table = bits.toArrow()  # at most 2 ** (BITMAP_BITS - 5) rows
    words_of[table["w"].to_numpy()] = table["m"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(words_of)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, text_hash long, name long, place int, start int, end int, n_words int, text_words int, cls binary, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, described = shared.value, set()
        for b in batches:
            raw, offsets = utf8_views(b.column(2))
            for start, end in blocks(offsets):
                block = raw[offsets[start] : offsets[end]]
                p = paragraphs(block, offsets[start : end + 1])
                chars = None
                for level in (p.lines, p.pieces):
                    name = level.name.view(np.int64)
                    at = name & ((1 << BITMAP_BITS) - 1)
                    hit = np.flatnonzero((bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
                    if not len(hit):
                        continue
                    if chars is None:
                        chars = np.zeros(len(block) + 1, np.int32)
                        np.cumsum((block & 0xC0) != 0x80, out=chars[1:])
                        base = chars[offsets[start : end + 1] - offsets[start]]
                        every = np.diff(np.searchsorted(p.starts, offsets[start : end + 1] - offsets[start])).astype(np.int32)
                    first, last, doc = level.first[hit], level.last[hit], level.doc[hit]
                    cls = pa.Array.from_buffers(pa.binary(16), len(hit), [None, pa.py_buffer(np.column_stack([level.name[hit], level.second[hit]]).astype(">u8").tobytes())]).cast(pa.binary())
                    sets = [None] * len(hit)
                    if level is p.lines:  # a task describes a class once, or a few times within a block
                        for i, c in enumerate(cls.to_pylist()):
                            if c not in described:
                                sets[i] = np.unique(p.flat[p.bounds[hit[i]] : p.bounds[hit[i] + 1]]).tobytes()
                                described.add(c)
                        if len(described) > 1 << 18:
                            described.clear()
                    columns = [
                        b.column(0).take(pa.array(doc + start)),
                        b.column(1).take(pa.array(doc + start)),
                        pa.array(name[hit]),
                        pa.array(level.place[hit].astype(np.int32)),
                        pa.array(chars[p.starts[first]] - base[doc]),
                        pa.array(chars[p.ends[last - 1]] - base[doc]),
                        pa.array((last - first).astype(np.int32)),
                        pa.array(every[doc]),
                        cls,
                        pa.array(sets, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    found = docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)
    return found.join(wanted, "name", "left_semi")


def _described(found: DataFrame) -> DataFrame:
    """``(cls, n, sig, keys, shingles)`` of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = [np.frombuffer(x.as_buffer(), U) for x in b.column(1)]
                sig = signatures(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), BANDS * ROWS)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int64()), lists(sig), lists(band_keys(sig)), b.column(1)], ["cls", "n", "sig", "keys", "shingles"])

    once = found.filter("shingles is not null").groupBy("cls").agg(F.first("shingles").alias("shingles"))
    return once.mapInArrow(run, "cls binary, n long, sig array<int>, keys array<bigint>, shingles binary")


def _across_documents(found: DataFrame, heads: bool = False) -> DataFrame:
    """Occurrences whose component lies in two documents or more; with ``heads``, also its first occurrence."""
    document, place = F.struct("id", "text_hash"), F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "place")
    spans = found.groupBy("component").agg(F.min(document).alias("lo"), F.max(document).alias("hi"), *([F.min(place).alias("head")] if heads else []))
    # Written first, so that the join has a shuffle on either side and a component with very many rows can be split.
    spans = materialize(spans.filter(~F.col("lo").eqNullSafe(F.col("hi"))).drop("lo", "hi"), "spans")
    return found.join(spans, "component")


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """See ``_repeated``; Python gets small batches, for pairs of paragraphs come with their full sets."""
    with arrow_batch_rows(docs.sparkSession, BATCH_ROWS):
        return _repeated(docs, percent, min_run, id_col, text_col)


def _repeated(docs: DataFrame, percent: int, min_run: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_hash, level, paragraph, start, end, n_words, component_id, kept)`` of every paragraph that repeats across documents.

    ``paragraph`` numbers the lines and the pieces of a document, each from 0; a line and its pieces may both be there.
    ``start`` and ``end`` are code points of the text, ``component_id`` is the least id in the component;
    ``text_hash`` is the text's 64-bit hash, by which rows of one id are told apart.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    wanted = _collisions(docs)
    release_shuffles(spark)
    level = F.when(F.col("name").bitwiseAND(1) == 1, "piece").otherwise("line")
    found = materialize(_occurrences(docs, wanted).withColumn("level", level).drop("name"), "paragraphs")
    release_shuffles(spark)
    classes = materialize(_described(found), "paragraph-classes")
    shared = classes.select(F.explode("keys").alias("key"), "cls").groupBy("key").agg(F.count("*").alias("posts")).filter("posts > 1")
    prefixes = classes.select("cls", F.explode("keys").alias("key")).join(shared, "key").groupBy("cls").agg(F.collect_list("key").alias("keys"))
    release_shuffles(spark)
    joined = merge_lists(materialize(prefixes, "paragraph-lists"), classes.select("cls", "n", "sig"), classes.select("cls", "shingles"), ROWS, percent)

    release_shuffles(spark)

    # Only lines have components of several classes; a piece is one with its equals.
    lines = found.filter("level = 'line'").drop("shingles").join(joined.withColumnRenamed("node", "cls"), "cls", "left")
    named = lines.withColumn("component", F.coalesce("component", "cls")).unionByName(found.filter("level = 'piece'").drop("shingles").withColumn("component", F.col("cls")))
    seen, found = found, materialize(_across_documents(named.drop("cls")), "repeats")
    discard(seen)
    release_shuffles(spark)
    row = W.partitionBy("id", "text_hash", "level").orderBy("place")
    new = found.withColumn("before", F.lag("place").over(row)).filter("before is null or before < place").drop("before")  # rows equal in id and text
    begins = F.coalesce(F.col("place") - F.lag("place").over(row) > GAP, F.lit(True)).cast("int")
    run = new.withColumn("begins", begins).withColumn("run", F.sum("begins").over(row)).drop("begins")
    run = run.withColumn("run_words", F.sum("n_words").over(W.partitionBy("id", "text_hash", "level", "run")))
    run = run.filter((F.col("run_words") >= min_run) | (100 * F.col("run_words") >= percent * F.col("text_words")))
    seen, found = found, materialize(run.drop("run", "run_words", "text_words"), "repeats")
    discard(seen)
    release_shuffles(spark)
    found = _across_documents(found, heads=True)
    kept = (F.col("head.id").eqNullSafe(F.col("id"))) & (F.col("head.text_hash") == F.col("text_hash")) & (F.col("head.place") == F.col("place"))
    return found.select(F.col("id").alias(id_col), "text_hash", "level", F.col("place").alias("paragraph"), "start", "end", "n_words", F.col("head.id").alias("component_id"), kept.alias("kept"))


def repeated_lines(docs: DataFrame, least_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(line, digest, documents, first_id)`` of every line, of any length, that so many documents have.

    Lines are compared without the white space at their ends and with A-Z lower-cased, by SHA-256; empty ones
    are left out.  Rows equal in id and text are one document; ``first_id`` is null only where all ids are.
    """
    line = F.explode(F.split(F.translate(F.col(text_col).cast("string"), UPPER, SMALL), "\n"))
    # A document counts once a line; then lines add up before the shuffle.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), line.alias("line"))
    rows = rows.withColumn("line", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")).filter("line <> ''")
    once = rows.groupBy(F.sha2("line", 256).alias("digest"), "id", "text_hash").agg(F.first("line").alias("line"))
    return once.groupBy("digest").agg(F.first("line").alias("line"), F.count("*").alias("documents"), F.min("id").alias("first_id")).filter(F.col("documents") >= least_docs).select("line", "digest", "documents", "first_id")


def remove_repeats(docs: DataFrame, repeats: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the paragraphs of ``repeats`` that are not kept cut out of their texts; all columns and rows stay."""
    spans = repeats.filter("not kept").groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    joined = docs.join(spans, docs[id_col].eqNullSafe(spans["__id"]) & (F.xxhash64(text) == spans["__hash"]), "left")

    @F.pandas_udf("string")
    def cut(texts, cuts):
        out = []
        for t, c in zip(texts, cuts):
            at, kept = 0, []
            for s in c:  # lines and pieces may overlap
                kept.append(t[at : max(at, s["start"])])
                at = max(at, s["end"])
            out.append("".join([*kept, t[at:]]))
        return type(texts)(out)

    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    done = F.when(spans["__cuts"].isNull(), docs[text_col]).otherwise(cut(text, F.coalesce(spans["__cuts"], empty)))
    return joined.select(*((done if c == text_col else docs[quoted(c)]).alias(c) for c in docs.columns))


def op10_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))

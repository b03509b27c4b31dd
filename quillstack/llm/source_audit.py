"""Source divergence audit: how the words of each source differ from those of the other sources of its language.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased.  A language keeps the
terms that at least ``least_docs`` of its documents hold; V is their number.  In a group of documents, a kept
term with n occurrences there has the share ``1 + floor(10^9 (n + 1) / (N + V))``, N being the occurrences of all
kept terms there.  Two shares differ by ``floor((p - q)^2 / q)``; all of this is done in whole numbers.

* ``term`` rows: per source, the ``k`` kept terms that occur more there than in the whole language and differ most.
  They are found by radix selection: histograms over the next two bytes of the key (value descending, then the
  UTF-8 bytes of the term) name the bucket that holds the k-th row of each source, and the next histogram looks
  into these buckets only, until a bucket has few rows.  No source is ever sorted as a whole.
* ``pair`` rows: per source and other source of its language, the sum of the differences over all kept terms.
  Most terms are in neither of the two, and add the difference of their baselines (n = 0) each.  So the sum is V
  times that, corrected by the counts that each source has (terms with equal counts at once) and by the terms
  that both have; no table of all terms by all sources is made.

Texts are counted in numpy and Arrow, a block at a time, and counts added up before anything is shuffled: a word
that is everywhere is one row a task, or one for each ``HELD`` counts.

Defined results: a null text, language or source counts as empty; repeated rows are documents each; a source
without kept terms has pairs, with a share of n = 0 for each term, and no term rows; where V is 0, pairs have
the value 0; empty tables give an empty result; other columns are ignored.  Exact up to 9 * 10^15 words a language.
"""

from __future__ import annotations

import os.path
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blocks, discard, materialize, utf8_views

LEAST_DOCS, TOP = 3, 200
#: Bytes of a long text that are split at once, counts that a task holds, and rows beyond ``k`` that are simply ranked.
STRETCH, HELD, SLACK = 1 << 20, 1 << 20, 256
#: Bytes of texts that are counted at once (a text with more is a long one), and rows of a batch for Spark.
BLOCK, ROWS = 1 << 23, 1 << 16
_INSIDE = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_TERM, _GAP = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _stretches(raw: bytes) -> Iterator[bytes]:
    """Pieces of a text that no term reaches across."""
    start = 0
    while start < len(raw):
        gap = _GAP.search(raw, start + STRETCH)
        end = gap.start() if gap else len(raw)
        yield raw[start:end]
        start = end


def _long_counts(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms of one text, a stretch at a time, with occurrences, and 1 document each."""
    counts: Counter = Counter()
    for piece in _stretches(raw):
        counts.update(_TERM.findall(piece.lower()))
    return pa.array(list(counts), pa.binary()).view(pa.string()), np.fromiter(counts.values(), np.int64, len(counts)), np.ones(len(counts), np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return begin, np.diff(np.append(begin, len(key)))


def _block_counts(raw: np.ndarray, at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """``(group, term, occurrences, documents)`` of the texts that lie at ``at`` in ``raw``, each of a group."""
    inside = _INSIDE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = at[:-1][at[:-1] < len(raw)]
    first[begins] = inside[begins]  # no term reaches from a text into the next
    starts = np.append(np.flatnonzero(first[inside]), np.count_nonzero(inside)).astype(np.int32)
    words = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(_LOWER[raw[inside]])]).dictionary_encode()
    if not len(words):
        return np.empty(0, np.int64), words.dictionary, np.empty(0, np.int64), np.empty(0, np.int64)
    size = len(words.dictionary)
    text = np.repeat(np.arange(len(group)), np.diff(np.searchsorted(np.flatnonzero(first), at)))
    key = np.sort(text * size + words.indices.to_numpy())
    begin, n = _runs(key)
    text, code = np.divmod(key[begin], size)
    key = group[text] * size + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin, docs = _runs(key)
    of, code = np.divmod(key[begin], size)
    return of, words.dictionary.take(pa.array(code)), np.add.reduceat(n[order], begin), docs


def _merged(held: list[pa.Table]) -> pa.Table:
    table = pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return table.select(["group", "term", "n_sum", "docs_sum"]).rename_columns(["group", "term", "n", "docs"])


def _emit(groups: dict[tuple[str, str], int], held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    langs, sources = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
    none = pa.array([0] * len(groups), pa.int64())
    # These rows tell that the groups are there, even if they have no term.
    yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(groups), pa.string()), none, none], schema=_COUNTS)
    for t in held:
        for b in t.to_batches(max_chunksize=ROWS):
            yield pa.RecordBatch.from_arrays([langs.take(b.column(0)), sources.take(b.column(0)), *b.columns[1:]], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], int] = {}
    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        raw, at = utf8_views(b.column(2))
        of = np.array([groups.setdefault(g, len(groups)) for g in zip(b.column(0).to_pylist(), b.column(1).to_pylist())], np.int64)
        for start, end in blocks(at, BLOCK):
            piece, bounds = raw[at[start] : at[end]], at[start : end + 1] - at[start]
            if len(piece) > BLOCK:  # one text
                terms, n, docs = _long_counts(piece.tobytes())
                group = np.full(len(terms), of[start])
            else:
                group, terms, n, docs = _block_counts(piece, bounds, of[start:end])
            held.append(pa.table([pa.array(group), terms, pa.array(n), pa.array(docs)], names=["group", "term", "n", "docs"]))
            rows += len(terms)
            if rows > 2 * HELD:
                held = [_merged(held)]
                rows = held[0].num_rows
            if rows > HELD and len(held) == 1:
                yield from _emit(groups, held)
                held, rows = [], 0
    if held:
        held = [_merged(held)]
    yield from _emit(groups, held)


def term_counts(documents: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences, and documents that hold the term; a row with a null term for each group."""
    none = F.lit("")
    texts = documents.select(F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # Tasks have added up what they have: adding up again before the shuffle would merge next to nothing.
    return counted.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, size: str, kept: str) -> str:
    """``1 + floor(10^9 (n + 1) / (size + kept))`` in longs: a long division, three digits at a time."""
    whole, rest, left = f"({size} + {kept})", f"(({n}) + 1)", []
    for _ in range(3):
        left.append(f"({rest} * 1000 div {whole})")
        rest = f"({rest} * 1000 % {whole})"
    return f"(1 + {left[0]} * 1000000 + {left[1]} * 1000 + {left[2]})"


def _differ(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def leading(rows: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """Of each group, the rows with the ``k`` least values of the binary column ``key``, and up to ``SLACK`` that follow them.

    Keys are distinct within a group.  What is kept of a group between rounds is one row.
    """
    common = F.udf(lambda a, b: bytearray(os.path.commonprefix([bytes(a), bytes(b)])), "binary")
    facts = [F.count("*").alias("n"), F.min(key).alias("least"), F.max(key).alias("most")]
    state = rows.groupBy(*by).agg(*facts).withColumn("need", F.lit(k).cast("long"))
    while True:
        # The next bytes to look at are those after what all keys of the bucket begin with.
        state = state.select(*by, "n", "need", common("least", "most").alias("prefix"))
        state = materialize(state.withColumn("open", F.expr(f"n > need + {SLACK}")), "leading")
        if not state.filter("open").limit(1).count():
            break
        inside = rows.join(state.filter("open").drop("n"), by).filter(F.expr(f"substring({key}, 1, length(prefix)) = prefix"))
        digit = F.expr(f"substring({key}, length(prefix) + 1, 2)").alias("digit")
        hist = inside.groupBy(*by, "need", digit).agg(*facts)  # 65,793 rows a group at most
        upto = hist.withColumn("upto", F.sum("n").over(W.partitionBy(*by).orderBy("digit")))
        bucket = upto.filter("upto >= need and upto - n < need").withColumn("need", F.expr("need - (upto - n)"))
        closed = state.filter("not open").select(*by, "n", "need", F.col("prefix").alias("least"), F.col("prefix").alias("most"))
        state = closed.unionByName(bucket.select(*closed.columns))
    kept = rows.join(state.select(*by, "prefix"), by).filter(F.expr(f"substring({key}, 1, length(prefix)) <= prefix"))
    return kept.drop("prefix")


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(held: DataFrame, stats: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of all ordered pairs of sources."""
    base = stats.withColumn("base", F.expr(f"if(kept > 0, {_share('0', 'size', 'kept')}, 1)"))
    mine = base.select("lang", "kept", F.col("source").alias("a"), F.col("base").alias("pa"))
    other = base.select("lang", F.col("source").alias("b"), F.col("base").alias("pb"))
    # Terms with the same count have the same share: a source has few different counts.
    counts = held.groupBy("lang", "source", "share").agg(F.count("*").alias("terms"))
    of = lambda name: counts.select("lang", F.col("source").alias(name), F.col("share").alias(f"p{name}t"), "terms")
    total = lambda df, value: df.groupBy("lang", "a", "b").agg(F.sum(F.expr(value)).alias("value"))
    ordered = mine.join(other, "lang").filter("a <> b")  # the pairs that are asked for, all of them
    whole = ordered.select("lang", "a", "b", F.expr(f"kept * {_differ('pa', 'pb')}").alias("value"))
    left = total(ordered.join(of("a"), ["lang", "a"]), f"terms * ({_differ('pat', 'pb')} - {_differ('pa', 'pb')})")
    right = total(ordered.join(of("b"), ["lang", "b"]), f"terms * ({_differ('pa', 'pbt')} - {_differ('pa', 'pb')})")
    shares = held.join(base.select("lang", "source", "base"), ["lang", "source"])
    end = lambda name: shares.select("lang", "term", F.col("source").alias(name), F.col("base").alias(f"p{name}"), F.col("share").alias(f"p{name}t"))
    both = end("a").join(end("b"), ["lang", "term"]).filter("a <> b")  # a row for each two sources that share a term
    both = total(both, f"{_differ('pat', 'pbt')} - {_differ('pat', 'pb')} - {_differ('pa', 'pbt')} + {_differ('pa', 'pb')}")
    parts = whole.unionByName(left).unionByName(right).unionByName(both)
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)``, see above."""
    counted = materialize(term_counts(documents), "terms")
    terms = counted.filter(F.col("term").isNotNull())
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(kept, "kept")
    chosen = materialize(terms.drop("docs").join(kept.hint("shuffle_hash"), ["lang", "term"]), "kept-terms")
    sizes = chosen.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_size"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    stats = counted.filter(F.col("term").isNull()).select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    stats = materialize(stats.select("lang", "source", zero("size"), zero("kept"), zero("all_size")), "source-sizes")
    shares = chosen.join(stats, ["lang", "source"])
    shares = shares.select("lang", "source", "term", F.expr(_share("n", "size", "kept")).alias("share"), F.expr(_share("all_n", "all_size", "kept")).alias("usual"))
    shares = materialize(shares, "shares")
    value = shares.filter("share > usual").select("lang", "source", F.col("term").alias("item"), F.expr(_differ("share", "usual")).alias("value"))
    key = F.concat(F.unhex(F.lpad(F.hex(F.lit((1 << 63) - 1) - F.col("value")), 16, "0")), F.encode("item", "UTF-8"))
    best = leading(value.withColumn("key", key), ["lang", "source"], "key", k)
    result = _ranked(best, "term").filter(F.col("rank") <= k).unionByName(_ranked(_pairs(shares, stats), "pair"))
    result = materialize(result, "audit")
    for table in (counted, kept, chosen, stats, shares):
        discard(table)
    return result


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))

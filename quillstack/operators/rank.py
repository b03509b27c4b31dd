"""Okapi BM25 over character bigrams (Robertson and Zaragoza 2009).

``k1`` is 1.2 and ``b`` 0.75; a gram that more than half of the messages have weighs ``1e-6``; smaller
scores are better.  Lengths are counted over all six fields; a term of one field counts its grams in
that field only.  Every occurrence of a gram in the query counts for itself; negated terms add nothing.

The statistics of all grams of the query are a single row, from one aggregation over the corpus or from
the dictionary of a store; the score is then an expression of the row, so ranking is a scan of the
matches and a top-k without a join.  With a store, ``indexed.best`` opens only what can be on the page.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.compile import FOLDED, folded_column
from ..plans.query_language import Query

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
Gram = tuple[str, str | None]


class Stats(NamedTuple):
    messages: int
    average_length: float
    holders: dict[Gram, int]


def query_grams(q: Query) -> list[Gram]:
    """Grams of the positive terms and OR pairs with their fields, repeats included."""
    terms = [t for c in q.clauses for t in ((c,) if hasattr(c, "text") else (c.left, c.right)) if not t.negated]
    return [(g, t.field) for t in terms for g in X.bigrams_of(t.text)]


def count_of(gram: Gram) -> Column:
    """Occurrences in a message: in the gram's field, or over all six."""
    columns = [folded_column(gram[1])] if gram[1] else [F.col(c) for c in FOLDED.values()]
    return reduce(lambda a, b: a + b, (X.occurrences(c, gram[0]) for c in columns))


def stats_frame(mails: DataFrame, grams: list[Gram]) -> DataFrame:
    """One row: the number of messages, their mean length, and for each gram the number that have it."""
    distinct = list(dict.fromkeys(grams))
    return mails.agg(F.count("*").alias("n"), F.avg("n_grams").alias("avgdl"), *(F.count_if(F.contains(folded_column(f), F.lit(g))).alias(f"df{i}") for i, (g, f) in enumerate(distinct)))


def stats(mails: DataFrame, grams: list[Gram]) -> Stats:
    row = stats_frame(mails, grams).first()
    return Stats(row["n"], row["avgdl"] or 0.0, {g: row[f"df{i}"] for i, g in enumerate(dict.fromkeys(grams))})


def stats_from_index(index, grams: list[Gram]) -> Stats:
    """The same as ``stats``, from the dictionary of a store's snapshot: neither texts nor postings are read."""
    return Stats(index.rows, index.length / index.rows if index.rows else 0.0, index.frequencies(list(dict.fromkeys(grams))))


def idf(messages: int, holders: int) -> float:
    value = math.log((messages - holders + 0.5) / (holders + 0.5))
    return value if value > 0 else LEAST_IDF


def score(grams: list[Gram], s: Stats) -> Column:
    """The score of a message; 0 for a query without grams."""
    if not grams or not s.average_length:
        return F.lit(0.0)
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("n_grams") / F.lit(s.average_length))
    parts = []
    for gram in dict.fromkeys(grams):
        tf = count_of(gram).cast("double")
        parts.append(F.lit(idf(s.messages, s.holders[gram]) * grams.count(gram)) * tf * F.lit(K1 + 1) / (tf + norm))
    return -reduce(lambda a, b: a + b, parts)


def required_grams(q: Query) -> list[Gram]:
    """Grams, with their fields, that every match of a query has: those of its positive terms."""
    return list(dict.fromkeys((g, t.field) for t in q.terms() for g in X.bigrams_of(t.text)))

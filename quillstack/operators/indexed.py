"""Searches that use what a store knows: its dictionary, its blocks of postings and its months.

Each gives what a scan would give; the index changes what is read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..plans.query_language import Query
from . import blocks as B
from . import rank
from .store import NAMED, Snapshot, among, named

#: Lists that are intersected at most; those more than so many times as long as the shortest are left out.
LISTS, LONGER = 4, 8
#: A look-up is worth its job if the rarest gram is in at most one message of so many, and there are so many grams to scan.
SHARE, WORTH = 8, 1 << 26
#: Messages that the first group of months has at least, for each that is wanted, and in all; groups grow fourfold.
PAGES, PAGE_ROWS = 20, 500
#: Slices that a ranking opens first, and beyond which it scores all matches.
OPENED, MOST_OPENED = 16, 1024


def _is(gram: rank.Gram) -> Column:
    return (F.col("gram") == gram[0]) & (F.col("field") == (gram[1] or B.ALL))


def _lists(index: Snapshot, grams: list[rank.Gram]) -> DataFrame:
    """Blocks of the grams; the first test is one that Parquet's statistics answer."""
    return index.blocks().filter(F.col("gram").isin(sorted({g for g, _ in grams})) & reduce(lambda a, b: a | b, map(_is, grams)))


def holders(index: Snapshot, grams: list[rank.Gram]) -> DataFrame:
    """``(month, rowid, seq)`` of rows that have all grams, replaced ones included.

    A slice that lacks one of the grams is left out before its keys are looked at.
    """
    grams = list(dict.fromkeys(grams))
    slices = _lists(index, grams).groupBy("seq", "month", "slice").agg(F.collect_list("keys").alias("lists"))  # a list a gram, of a slice's rows
    both = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0)), F.array_intersect)
    return slices.filter(F.size("lists") == len(grams)).select("month", F.explode(both).alias("rowid"), "seq")


def candidates(index: Snapshot, grams: list[rank.Gram]) -> DataFrame:
    """``rowid`` of the messages that have all grams."""
    return index._live(holders(index, grams)).select("rowid")


def rarest(frequencies: dict[rank.Gram, int]) -> list[rank.Gram]:
    """The grams whose lists are read: the shortest, and others that are not much longer."""
    order = sorted(frequencies, key=lambda g: (frequencies[g], g[0], g[1] or ""))
    return [g for g in order if frequencies[g] <= LONGER * frequencies[order[0]]][:LISTS]


def narrowed(found: DataFrame, index: Snapshot, q: Query, worth: int = WORTH) -> DataFrame:
    """``found``, filtered messages of ``index``, read only where the grams of the query's terms can be.

    That is the months and keys of the messages that hold the rarest grams, where they can be named; where they
    are more, or a store is small, texts are scanned: a join with keys would read them all the same.
    """
    grams = rank.required_grams(q)
    if not grams:
        return found
    frequencies = index.frequencies(grams)
    least = min(frequencies.values())
    if least == 0:
        return found.filter(F.lit(False))
    if least > NAMED or least * SHARE > index.rows or index.length < worth:
        return found
    # Rows that were replaced may still be in the lists, so there can be more of them than messages.
    held = holders(index, rarest(frequencies)).select("month", "rowid").distinct().limit(2 * NAMED + 1).collect()
    return found.filter(named(held)) if len(held) <= 2 * NAMED else found


@dataclass
class Page:
    """Rows in order, and what was opened to find them."""

    rows: list[Row]
    opened: int
    of: int


def newest(found: DataFrame, index: Snapshot, limit: int, order: list[Column], columns: list[str]) -> Page:
    """The ``limit`` newest of ``found``: months from the last one on, in growing groups, until no later one can have more."""
    counts: dict[str, int] = {}
    for s in index.segments:
        for month, (n, _) in s["months"].items():
            counts[month] = counts.get(month, 0) + n
    last = index.months()
    months, rows, opened, size = sorted(last, reverse=True), [], 0, max(PAGES * limit, PAGE_ROWS)
    while opened < len(months):
        group, held = [], 0
        while opened + len(group) < len(months) and held < size:
            group.append(months[opened + len(group)])
            held += counts[group[-1]]
        rows += found.filter(F.col("month").isin(group)).orderBy(*order).limit(limit).select(*columns).collect()  # a page
        rows = sorted(rows, key=lambda r: (-r["rowid"], r["message_id"]))[:limit]
        opened += len(group)
        size *= 4
        # Keys follow time, but where a second has more messages than keys they may reach into a later month.
        if len(rows) == limit and all(last[m] < rows[-1]["rowid"] for m in months[opened:]):
            break
    return Page(rows, opened, len(months))


def _part(tf: str, length: str, weight: float, average: float) -> Column:
    """What a gram adds to a score, as ``rank.score`` has it."""
    norm = F.lit(rank.K1) * (F.lit(1 - rank.B) + F.lit(rank.B) * F.col(length) / F.lit(average))
    times = F.col(tf).cast("double")
    return F.lit(weight) * times * F.lit(rank.K1 + 1) / (times + norm)


def best(found: DataFrame, index: Snapshot, q: Query, limit: int, order: list[Column], columns: list[str]) -> Page | None:
    """The ``limit`` best of ``found`` by BM25, with ``score``, or None where all matches have to be scored.

    In each slice, the largest count and the least length of a gram bound what it adds; the slices that have all
    grams are opened in the order of these bounds, until the next cannot reach the last score of the page.
    Scores come from the blocks; only messages of opened slices are tested for the terms themselves.
    """
    grams = rank.query_grams(q)
    if q.pairs() or not grams or not index.rows or not index.length:
        return None
    distinct = list(dict.fromkeys(grams))
    stats = rank.stats_from_index(index, grams)
    if not all(stats.holders.values()):
        return Page([], 0, 0)
    weights = [rank.idf(stats.messages, stats.holders[g]) * grams.count(g) for g in distinct]
    lists = _lists(index, distinct)
    total = lambda names: reduce(lambda a, b: a + b, map(F.col, names))
    names = [f"__p{i}" for i in range(len(distinct))]
    bounds = [F.max(F.when(_is(g), _part("most", "least", w, stats.average_length))).alias(n) for g, w, n in zip(distinct, weights, names)]
    slices = lists.groupBy("seq", "month", "slice").agg(*bounds, F.min("first").alias("first"), F.max("last").alias("last"))
    slices = slices.withColumn("bound", total(names)).filter(F.col("bound").isNotNull()).drop(*names)
    ranked = slices.orderBy(F.desc("bound"), "seq", "month", "slice").limit(MOST_OPENED + 1).collect()
    rows: list[Row] = []
    done, opened = 0, OPENED
    while done < len(ranked):
        if opened > MOST_OPENED:
            return None
        now, done = ranked[done:opened], min(opened, len(ranked))
        rows += _scored(found, index, lists, now, distinct, weights, names, stats.average_length).orderBy(*order).limit(limit).select(*columns, "score").collect()
        rows = sorted(rows, key=lambda r: (r["score"], -r["rowid"], r["message_id"]))[:limit]
        # Bounds and scores are sums of the same terms in the same order; the margin is for the last bits.
        if done < len(ranked) and len(rows) == limit and ranked[done]["bound"] * (1 + 1e-9) < -rows[-1]["score"]:
            break
        opened *= 4
    return Page(rows, done, len(ranked))


def _scored(found: DataFrame, index: Snapshot, lists: DataFrame, now: list[Row], grams: list[rank.Gram], weights: list[float], names: list[str], average: float) -> DataFrame:
    """Messages of ``found`` that lie in the slices, with ``score``."""
    here = F.col("month").isin(sorted({r["month"] for r in now}))
    each = F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("x")
    posts = lists.filter(here & among("slice", [r["slice"] for r in now])).select("seq", "month", "gram", "field", each)
    posts = posts.select("seq", "month", "gram", "field", F.col("x.keys").alias("rowid"), F.col("x.tfs").alias("tf"), F.col("x.lengths").alias("length"))
    parts = [F.max(F.when(_is(g), _part("tf", "length", w, average))).alias(n) for g, w, n in zip(grams, weights, names)]
    scores = posts.groupBy("seq", "month", "rowid").agg(*parts)
    # Added in the order in which ``rank.score`` adds.
    scores = scores.withColumn("score", -reduce(lambda a, b: a + b, map(F.col, names))).filter(F.col("score").isNotNull()).drop(*names)
    inside = F.col("rowid").between(min(r["first"] for r in now), max(r["last"] for r in now))
    return found.filter(here & inside).join(scores, ["month", "rowid", "seq"])

"""Search, zero-hit diagnosis, lookups and folder lists over a prepared ``mails`` table."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import HIT_COLUMNS, Probe, SearchResult
from ..plans import compile as C
from ..plans.query_language import Query, Term, parse
from . import indexed, rank
from .store import Snapshot

PROBE_CAP = 1000


def newest_first() -> list[Column]:
    return [F.desc("rowid"), F.asc("message_id")]


def matches(mails: DataFrame, q: Query, whole_word: bool = False, below: int | None = None, folders: list[str] | None = None, index: Snapshot | None = None) -> DataFrame:
    """All messages of a query, in no order.  ``below`` pages by key; ``folders`` is an exact set.

    With an ``index``, the snapshot that ``mails`` is of, messages are read only where the grams of the positive
    terms can be, if these are rare enough to be worth the look-up.
    """
    found = mails.filter(C.predicate(q, prune="month" in mails.columns))
    if whole_word:
        found = found.filter(C.whole_word_predicate(q))
    if below is not None:
        found = found.filter(F.col("rowid") < below)
    if folders:
        found = found.filter(F.col("folder_path").isin(folders))
    return found if index is None else indexed.narrowed(found, index, q)


def top(found: DataFrame, limit: int, q: Query | None = None, stats: rank.Stats | None = None) -> DataFrame:
    """The ``limit`` newest messages or, with statistics, the best by BM25."""
    if stats is None:
        return found.orderBy(*newest_first()).limit(limit)
    scored = found.withColumn("score", rank.score(rank.query_grams(q), stats))
    return scored.orderBy(F.asc("score"), *newest_first()).limit(limit)


def hits(found: DataFrame, *more: str) -> DataFrame:
    return found.select(*HIT_COLUMNS, *more)


def search(
    mails: DataFrame,
    raw: str,
    limit: int = 20,
    sort: str = "date",
    whole_word: bool = False,
    below: int | None = None,
    folders: list[str] | None = None,
    relevance_candidates: int | None = None,
    now: datetime | None = None,
    index: Snapshot | None = None,
) -> SearchResult:
    """Runs a query.  ``relevance_candidates`` ranks only so many of the newest matches; otherwise all are ranked.

    With an ``index``, the snapshot that ``mails`` is of, newest matches are looked for from the last month on, the best
    from the most promising slice on, and of a query with a gram that no message has no text is read.
    """
    began = time.perf_counter()
    q = parse(raw, now)
    warnings = [*q.warnings, *(f"{t.label!r} is too short for the index; it was searched in the text" for t in q.terms() if not X.bigrams_of(t.text))]
    found = matches(mails, q, whole_word, below, folders, index)
    columns = list(HIT_COLUMNS)
    if sort == "relevance" and (grams := rank.query_grams(q)):
        page = None
        if relevance_candidates is not None:
            found = found.orderBy(*newest_first()).limit(relevance_candidates)
        elif index is not None:
            whole = matches(index.all_rows(), q, whole_word, below, folders)
            page = indexed.best(whole, index, q, limit + 1, [F.asc("score"), *newest_first()], columns)
        if page is None:
            stats = rank.stats(mails, grams) if index is None else rank.stats_from_index(index, grams)
            rows = hits(top(found, limit + 1, q, stats), "score").collect()
        else:
            rows = page.rows
        schema = hits(mails.withColumn("score", F.lit(0.0)), "score").schema
    else:
        if sort == "relevance":
            warnings.append("nothing to rank by; newest first")
        if index is None:
            rows = hits(top(found, limit + 1)).collect()  # a page, in order
        else:
            rows = indexed.newest(found, index, limit + 1, newest_first(), columns).rows
        schema = hits(mails).schema
    result = SearchResult(mails.sparkSession.createDataFrame(rows[:limit], schema), warnings, len(rows) > limit)
    if not rows:
        result.diagnosis = diagnose(mails, q, index=index)
        if whole_word and matches(mails, q, False, below, folders).limit(1).count():
            result.warnings.append("whole-word matching left no message")
    result.elapsed_ms = (time.perf_counter() - began) * 1000
    return result


def probes(q: Query) -> list[tuple[str, Column]]:
    """Every condition of a query, to be counted alone."""
    out = [(t.label, C.has_term(t)) for t in q.terms()]
    out += [(f"{p.left.label} OR {p.right.label}", C.clause(p)) for p in q.pairs()]
    out += [(f"NOT {t.label}", C.clause(t)) for t in q.terms(negated=True)]
    return out + C.filters(q, prune=False)


def diagnosis_frame(mails: DataFrame, q: Query, cap: int = PROBE_CAP) -> DataFrame:
    """``(label, n, count, culprit)`` of every condition, from one pass over the table."""
    found = probes(q)
    if not found:
        return mails.sparkSession.createDataFrame([], "label string, n long, count string, culprit boolean")
    one = mails.agg(*(F.count_if(c).alias(f"p{i}") for i, (_, c) in enumerate(found)))
    rows = F.explode(F.array(*(F.struct(F.lit(label).alias("label"), F.least(F.col(f"p{i}"), F.lit(cap)).alias("n")) for i, (label, _) in enumerate(found))))
    return one.select(rows.alias("r")).select("r.label", "r.n", X.count_text(F.col("r.n"), cap).alias("count"), (F.col("r.n") == 0).alias("culprit"))


def diagnose(mails: DataFrame, q: Query, cap: int = PROBE_CAP, index: Snapshot | None = None) -> list[Probe]:
    """With an ``index``, terms with a gram that no message has are told from the dictionary, and nothing else is read if these are all there is."""
    absent = set()
    if index is not None:
        held = index.frequencies(list(dict.fromkeys(rank.required_grams(q))))
        absent = {t.label for t in q.terms() if any(held[g, t.field] == 0 for g in X.bigrams_of(t.text))}
        if absent and len(probes(q)) == len(q.terms()) and absent == {t.label for t in q.terms()}:
            return [Probe(t.label, "0건", True) for t in q.terms()]
    return [Probe(r["label"], r["count"], r["culprit"]) for r in diagnosis_frame(mails, q, cap).collect()]


def capped_count(found: DataFrame, cap: int = PROBE_CAP) -> int:
    """Rows, counted up to ``cap``: the scan ends there."""
    return found.limit(cap).count()


def removed_by_whole_word(mails: DataFrame, q: Query) -> DataFrame:
    """``(matched, removed)``: how many matches the whole-word test drops."""
    return mails.filter(C.predicate(q, prune=False)).agg(F.count("*").alias("matched"), F.count_if(~C.whole_word_predicate(q)).alias("removed"))


def false_positives(mails: DataFrame, term: Term) -> DataFrame:
    """``(candidates, truth)``: messages that hold all bigrams of a term, and those that hold the term."""
    return mails.agg(F.count_if(C.gram_superset(term)).alias("candidates"), F.count_if(C.has_term(term)).alias("truth"))


def list_folders(mails: DataFrame) -> DataFrame:
    return mails.select("folder_path").filter("folder_path <> ''").distinct().orderBy("folder_path")


def highlighted(found: DataFrame, q: Query, column: str = "body", name: str = "highlighted") -> DataFrame:
    """``found`` with what the positive terms find in a column marked: those of that field, and those of none."""
    return found.withColumn(name, X.highlight(F.col(column), [t.text for t in q.terms() if t.field in (None, column)]))

"""Compiles a parsed query into one ``Column`` predicate over a prepared ``mails`` table.

The predicate is plain JVM expressions over columns that were folded at ingest, so Catalyst pushes
the substring tests and the ranges to the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import FIELD_COLUMNS
from .query_language import Either, Query, Term

#: Column with the folded text of a field.
FOLDED = {name: f"f_{name}" for name in FIELD_COLUMNS}
FOLDED_ALL = "f_all"


def with_search_columns(mails: DataFrame, strip_quotes: bool = True, exact_fold: bool = True) -> DataFrame:
    """``mails`` with the folded fields, all of them joined, the gram count and the month of each message."""
    fold = X.fold if exact_fold else X.native_fold
    names = F.col("attachment_names")
    if dict(mails.dtypes)["attachment_names"] != "string":
        names = X.attachment_text(names)
    body = X.strip_quoted(F.col("body")) if strip_quotes else F.coalesce("body", F.lit(""))
    texts = {"subject": F.col("subject"), "body": body, "from": F.col("from_addr"), "to": F.col("to_addr"), "cc": F.col("cc_addr"), "attachments": names}
    out = mails.withColumns({FOLDED[f]: fold(F.coalesce(t, F.lit(""))) for f, t in texts.items()})
    out = out.withColumn(FOLDED_ALL, F.concat_ws(" \n ", *(FOLDED[f] for f in texts)))
    grams = reduce(lambda a, b: a + b, (X.bigram_count(F.col(FOLDED[f])) for f in texts))
    return out.withColumns({"n_grams": grams, "month": F.date_format(F.timestamp_seconds("date_utc"), "yyyy-MM")})


def folded_column(name: str | None) -> Column:
    return F.col(FOLDED[name] if name else FOLDED_ALL)


def has_term(term: Term) -> Column:
    return X.contains(folded_column(term.field), X.fold_text(term.text))


def has_whole_word(term: Term) -> Column:
    """Whole-word test of a term; anything but plain ASCII words passes."""
    if not X.is_plain_word(term.text):
        return F.lit(True)
    return X.whole_word(folded_column(term.field), X.fold_text(term.text))


def gram_superset(term: Term) -> Column:
    """Whether all bigrams of a term occur: what an index of bigrams answers before verification."""
    tests = [F.contains(folded_column(term.field), F.lit(g)) for g in dict.fromkeys(X.bigrams_of(term.text))]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def clause(c: Term | Either) -> Column:
    if isinstance(c, Either):
        return has_term(c.left) | has_term(c.right)
    return ~has_term(c) if c.negated else has_term(c)


def folder_filter(folders: list[str]) -> Column:
    path = X.ascii_fold(F.col("folder_path"))
    return reduce(lambda a, b: a | b, (F.contains(path, X.ascii_fold(F.lit(f))) for f in folders))


def file_filter(file: str) -> Column:
    return F.contains(X.ascii_fold(F.col("file_path")), X.ascii_fold(F.lit(file)))


def date_filter(after: int | None, before: int | None, prune: bool = True) -> Column:
    """A half-open range of seconds, and the months that it can touch, for partition pruning."""
    date, out = F.col("date_utc"), F.lit(True)
    month = lambda t: F.date_format(F.timestamp_seconds(F.lit(t)), "yyyy-MM")
    if after is not None:
        out = out & (date >= after)
        out = out & (F.col("month") >= month(after)) if prune and abs(after) < 1 << 37 else out
    if before is not None:
        out = out & (date < before)
        out = out & (F.col("month") <= month(before)) if prune and abs(before) < 1 << 37 else out
    return out


def size_comparison(op: str, size: int) -> Column:
    column = F.col("size_bytes")
    return {">": column > size, ">=": column >= size, "<": column < size, "<=": column <= size}[op]


def filters(q: Query, prune: bool = True) -> list[tuple[str, Column]]:
    """The structured filters of a query, each with a label."""
    out = []
    if q.folders:
        out.append(("folder:" + " OR folder:".join(q.folders), folder_filter(q.folders)))
    if q.has_attachment is not None:
        out.append((f"hasattachment:{'yes' if q.has_attachment else 'no'}", F.col("has_attachment") == q.has_attachment))
    if q.after is not None or q.before is not None:
        out.append(("date", date_filter(q.after, q.before, prune)))
    if q.size is not None:
        out.append((f"size:{q.size[0]}{q.size[1]}", size_comparison(*q.size)))
    if q.file is not None:
        out.append((f"file:{q.file}", file_filter(q.file)))
    return out


def predicate(q: Query, prune: bool = True) -> Column:
    """All clauses and filters of a query; an empty query holds for every row."""
    return reduce(lambda a, b: a & b, [clause(c) for c in q.clauses] + [c for _, c in filters(q, prune)], F.lit(True))


def whole_word_predicate(q: Query, either: bool = False) -> Column:
    """Whole-word tests of the positive terms; of OR pairs too if ``either``."""
    tests = [has_whole_word(t) for t in q.terms()]
    if either:
        tests += [(has_term(p.left) & has_whole_word(p.left)) | (has_term(p.right) & has_whole_word(p.right)) for p in q.pairs()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))

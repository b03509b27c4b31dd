from __future__ import annotations

from datetime import datetime, timezone

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillstack.plans.query_language import ALIASES, Either, Term, compose, parse
from quillstack.plans.time_values import NOTHING, date_range, size_filter

NOW = datetime(2024, 6, 15, 10, 30, tzinfo=timezone.utc)


def texts(q, negated=False):
    return [t.text for t in q.terms(negated)]


def test_there_are_28_aliases_of_13_fields():
    assert len(ALIASES) == 28
    assert len(set(ALIASES.values())) == 13


@pytest.mark.parametrize("raw, field", [("from:a", "from"), ("보낸사람:a", "from"), ("제목:a", "subject"), ("CONTENT:a", "body"), ("첨부:a", "attachments"), ("참조:a", "cc")])
def test_text_aliases(raw, field):
    assert parse(raw).clauses == [Term("a", field)]


def test_structured_filters():
    q = parse('folder:"a b" in:c file:x.pst has:attachment messagesize:>1MB after:2024-01-02 before:2024-02-03', NOW)
    assert (q.folders, q.file, q.has_attachment, q.size) == (["a b", "c"], "x.pst", True, (">", 1 << 20))
    assert (q.after, q.before) == (1704153600, 1706918400)
    assert not q.clauses and not q.warnings


def test_negation_and_or():
    assert texts(parse("a NOT b -c"), True) == ["b", "c"]
    assert parse("a OR b").clauses == [Either(Term("a"), Term("b"))]
    assert parse('-from:x -"p q"').clauses == [Term("x", "from", True), Term("p q", None, True)]


@pytest.mark.parametrize("raw, positive", [("a OR b OR c", ["c"]), ("OR a", ["a"]), ("a OR NOT b", ["a"])])
def test_or_degrades_to_and_with_a_warning(raw, positive):
    q = parse(raw)
    assert texts(q) == positive
    assert q.warnings


def test_or_does_not_reach_past_a_filter():
    q = parse("계약 OR folder:법무 회의록")
    assert texts(q) == ["계약", "회의록"] and not q.pairs() and q.folders == ["법무"] and q.warnings


def test_not_does_not_leak_past_a_filter():
    q = parse("NOT folder:x y")
    assert texts(q) == ["y"] and q.warnings


def test_phrases_and_unknown_prefixes():
    assert texts(parse('"a  b" note:x http://h')) == ["a  b", "note:x", "http://h"]
    assert texts(parse('say "unclosed')) == ["say", '"unclosed']


def test_empty_terms_and_odd_values_warn():
    for raw in ('""', "hasattachment:maybe", "date:nonsense", "messagesize:big", "date:2024-13"):
        q = parse(raw, NOW)
        assert not q.clauses and q.warnings, raw


@pytest.mark.parametrize(
    "value, expected",
    [
        ("2024", (1704067200, 1735689600)),
        ("2024-03", (1709251200, 1711929600)),
        ("2024-03-15", (1710460800, 1710547200)),
        ("2024-12", (1733011200, 1735689600)),
        ("2024-01-01..2024-02-01", (1704067200, 1706832000)),
        ("7d", (int(NOW.timestamp()) - 7 * 86400, None)),
        ("2m", (int(NOW.timestamp()) - 60 * 86400, None)),
        ("1y", (int(NOW.timestamp()) - 365 * 86400, None)),
        ("today", (1718409600, 1718496000)),
        ("어제", (1718323200, 1718409600)),
        ("thisweek", (1717977600, 1718582400)),
        ("지난주", (1717372800, 1717977600)),
        ("이번달", (1717200000, 1719792000)),
        ("올해", (1704067200, 1735689600)),
        ("nonsense", NOTHING),
        ("2024-02-30", NOTHING),
        ("9999", NOTHING),
        ("99999999999d", NOTHING),
    ],
)
def test_dates(value, expected):
    assert date_range(value, NOW) == expected


@pytest.mark.parametrize("value, expected", [(">1MB", (">", 1048576)), ("<500KB", ("<", 512000)), ("2GB", (">=", 2147483648)), ("<=1.5kb", ("<=", 1536)), ("7", (">=", 7)), ("junk", None), ("1.2.3", None)])
def test_sizes(value, expected):
    assert size_filter(value) == expected


def test_before_uses_the_start_of_its_period():
    assert parse("before:2024", NOW).before == 1704067200
    assert parse("older_than:7d", NOW).before == int(NOW.timestamp()) - 7 * 86400


def test_compose():
    assert compose("x", from_="a b", after="2024", has_attachment=True) == 'x from:"a b" after:2024 hasattachment:yes'


@given(st.text(max_size=40))
def test_parsing_never_fails(raw):
    parse(raw, NOW)


@given(st.lists(st.sampled_from(["a", '"', "OR", "NOT", "-", "date:", "date:9", "size:", "크기:1.2.3", "folder:x", 'from:"', " ", "..", "and"]), max_size=12))
def test_parsing_of_fragments_never_fails(parts):
    parse(" ".join(parts), NOW)
    parse("".join(parts), NOW)

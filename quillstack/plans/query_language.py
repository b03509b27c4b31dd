"""The query language: a scanner and a parser that never fail on user text.

Terms are ANDed.  ``OR`` joins two neighbouring positive terms, ``NOT`` or a leading ``-`` negates,
quotes make a phrase, ``field:value`` searches one field or sets a structured filter.  What can't be
understood becomes a warning or a plain term.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

from .time_values import date_range, size_filter

#: Prefix to canonical field.
ALIASES = {
    "from": "from",
    "보낸사람": "from",
    "to": "to",
    "받는사람": "to",
    "cc": "cc",
    "참조": "cc",
    "subject": "subject",
    "제목": "subject",
    "body": "body",
    "content": "body",
    "본문": "body",
    "attachments": "attachments",
    "filename": "attachments",
    "첨부": "attachments",
    "hasattachment": "hasattachment",
    "folder": "folder",
    "in": "folder",
    "폴더": "folder",
    "received": "date",
    "date": "date",
    "날짜": "date",
    "after": "date_after",
    "newer_than": "date_after",
    "before": "date_before",
    "older_than": "date_before",
    "messagesize": "size",
    "크기": "size",
    "file": "file",
}
TEXT_FIELDS = ("subject", "body", "from", "to", "cc", "attachments")
YES, NO = ("yes", "true", "1"), ("no", "false", "0")
HAS_VALUES = ("attachment", "attachments", "yes", "true")


@dataclass(frozen=True)
class Term:
    text: str
    field: str | None = None  #: None searches all fields
    negated: bool = False

    @property
    def label(self) -> str:
        return f"{self.field}:{self.text}" if self.field else self.text


@dataclass(frozen=True)
class Either:
    left: Term
    right: Term


@dataclass
class Query:
    clauses: list[Term | Either] = field(default_factory=list)
    has_attachment: bool | None = None
    folders: list[str] = field(default_factory=list)
    file: str | None = None
    after: int | None = None
    before: int | None = None
    size: tuple[str, int] | None = None
    warnings: list[str] = field(default_factory=list)

    def terms(self, negated: bool = False) -> list[Term]:
        return [c for c in self.clauses if isinstance(c, Term) and c.negated == negated]

    def pairs(self) -> list[Either]:
        return [c for c in self.clauses if isinstance(c, Either)]


@dataclass(frozen=True)
class Token:
    text: str
    prefix: str | None = None  #: of ``prefix:text``
    quoted: bool = False
    minus: bool = False


def _is_prefix_char(c: str) -> bool:
    return c.isascii() and (c.isalpha() or c == "_") or "가" <= c <= "힣"


def scan(raw: str) -> Iterator[Token]:
    """Tokens from left to right; an unclosed quote is an ordinary character."""
    at, end = 0, len(raw)
    while at < end:
        if raw[at].isspace():
            at += 1
            continue
        minus = raw[at] == "-" and at + 1 < end and not raw[at + 1].isspace()
        begin = at + minus
        name = begin
        while name < end and _is_prefix_char(raw[name]):
            name += 1
        prefix = None
        if begin < name < end - 1 and raw[name] == ":" and not raw[name + 1].isspace():
            prefix, begin = raw[begin:name], name + 1
        close = raw.find('"', begin + 1) if raw[begin] == '"' else -1
        if close >= 0:
            yield Token(raw[begin + 1 : close], prefix, True, minus)
            at = close + 1
            continue
        at = begin
        while at < end and not raw[at].isspace():
            at += 1
        yield Token(raw[begin:at], prefix, False, minus)


class _Parser:
    def __init__(self, now: datetime):
        self.query, self.now = Query(), now
        self.negate = self.either = False

    def warn(self, text: str) -> None:
        self.query.warnings.append(text)

    def run(self, raw: str) -> Query:
        for token in scan(raw):
            word = token.text.lower() if token.prefix is None and not token.quoted and not token.minus else None
            if word == "and":
                continue
            if word == "or":
                self.either = True
            elif word == "not":
                self.negate = True
            elif token.prefix is not None and self.structured(token):
                if self.either:
                    self.degrade()
                if self.negate or token.minus:
                    self.warn(f"NOT does not apply to the filter {token.prefix}:{token.text}")
                self.negate = False
            else:
                self.term(token)
        return self.query

    def degrade(self) -> None:
        self.warn("OR needs a plain term on either side; AND was used")
        self.either = False

    def term(self, token: Token) -> None:
        name = ALIASES.get((token.prefix or "").lower())
        text = token.text if token.prefix is None or name in TEXT_FIELDS else f"{token.prefix}:{token.text}"
        term = Term(text, name if name in TEXT_FIELDS else None, self.negate or token.minus)
        self.negate = False
        if not text:
            self.warn("an empty term was ignored")
            return
        clauses = self.query.clauses
        if self.either and clauses and isinstance(clauses[-1], Term) and not clauses[-1].negated and not term.negated:
            clauses[-1] = Either(clauses[-1], term)
            self.either = False
            return
        if self.either:
            self.degrade()
        clauses.append(term)

    def structured(self, token: Token) -> bool:
        """Fills a slot of the query, if the prefix names one."""
        q, name, value = self.query, ALIASES.get(token.prefix.lower()), token.text
        if token.prefix.lower() == "has" and value.strip().lower() in HAS_VALUES:
            q.has_attachment = True
        elif name == "hasattachment":
            low = value.strip().lower()
            q.has_attachment = True if low in YES else False if low in NO else None
            if q.has_attachment is None:
                self.warn(f"not yes or no, ignored: {value!r}")
        elif name == "folder":
            q.folders.append(value)
        elif name == "file":
            q.file = value
        elif name in ("date", "date_after", "date_before"):
            start, stop = date_range(value, self.now)
            if start is None and stop is None:
                self.warn(f"not a date, ignored: {value!r}")
            elif name == "date_after":
                q.after = start
            elif name == "date_before":  # up to where the period begins
                q.before = start
            else:
                q.after = q.after if start is None else start
                q.before = q.before if stop is None else stop
        elif name == "size":
            q.size = size_filter(value) or q.size
            if size_filter(value) is None:
                self.warn(f"not a size, ignored: {value!r}")
        else:
            return False
        return True


def parse(raw: str, now: datetime | None = None) -> Query:
    return _Parser(now or datetime.now(timezone.utc)).run(raw)


def compose(text: str = "", **flags: str | bool | None) -> str:
    """Query text for command-line flags: ``from``, ``to``, ``subject``, ``after``, ``before``, ``folder``, ``has_attachment``."""
    parts = [text] if text else []
    for name in ("from", "to", "subject", "after", "before", "folder"):
        if value := flags.get(name) or flags.get(f"{name}_"):
            parts.append(f'{name}:"{value}"' if " " in str(value) else f"{name}:{value}")
    if (has := flags.get("has_attachment")) is not None:
        parts.append(f"hasattachment:{'yes' if has in (True, 'yes') else 'no'}")
    return " ".join(parts)

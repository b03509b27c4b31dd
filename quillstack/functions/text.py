"""Text expressions.  All but ``fold`` and ``addresses`` stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from email.utils import getaddresses

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Characters that make up index tokens.
TOKEN_CLASS = "0-9a-z가-힣ㄱ-ㆎ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: the line from which on a message only quotes another.
QUOTE_HEADER = r"^[ \t]*-{2,}[ \t]*(Original Message|원본 메시지)[ \t]*-{2,}.*\z"
QUOTE_LINE = r"^[ \t]*[>|]"


def fold_text(text: str) -> str:
    return unicodedata.normalize("NFKC", text).casefold()


@F.pandas_udf(StringType())
def fold(text: pd.Series) -> pd.Series:
    """NFKC and case folding, exactly; null is empty."""
    return text.fillna("").map(lambda x: x.lower() if x.isascii() else fold_text(x))


def native_fold(text: Column) -> Column:
    """The same for texts that NFKC leaves alone and whose only special case folding is that of the sharp s."""
    return F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss"))


def ascii_fold(text: Column) -> Column:
    """A-Z to a-z; for paths, which are compared without regard to ASCII case only."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def strip_quoted(body: Column) -> Column:
    """A body without the message it quotes: from the header line of an original message on, and lines marked ``>`` or ``|``."""
    cut = F.regexp_replace(F.coalesce(body, F.lit("")), "(?dmisu)" + QUOTE_HEADER, "")
    return F.array_join(F.filter(F.split(cut, "\n"), lambda line: ~line.rlike(QUOTE_LINE)), "\n")


def tokens(folded: Column) -> Column:
    """Index tokens of two characters or more."""
    return F.filter(F.split(folded, f"[^{TOKEN_CLASS}]+"), lambda t: F.length(t) >= 2)


def bigrams(folded: Column) -> Column:
    """Neighbouring pairs of characters within tokens, in order, with repeats."""
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    return F.flatten(F.transform(tokens(folded), pairs))


def bigrams_of(text: str) -> list[str]:
    """The same for a query term, on the driver."""
    return [t[i : i + 2] for t in re.split(f"[^{TOKEN_CLASS}]+", fold_text(text)) for i in range(len(t) - 1)]


def bigram_count(folded: Column) -> Column:
    """``size(bigrams(folded))`` without building them: token characters less the runs that they form."""
    runs = F.regexp_count(folded, F.lit(f"[{TOKEN_CLASS}]+"))
    return (F.length(F.regexp_replace(folded, f"[^{TOKEN_CLASS}]+", "")) - runs).cast("long")


def occurrences(folded: Column, gram: str) -> Column:
    """How often a pair of token characters occurs; occurrences may overlap."""
    if gram[0] == gram[1]:
        return F.regexp_count(folded, F.lit(f"(?={re.escape(gram)})")).cast("long")
    return F.floor((F.length(folded) - F.length(F.replace(folded, F.lit(gram), F.lit("")))) / 2).cast("long")


def row_key(date_utc: Column, message_id: Column) -> Column:
    """A key in order of time: seconds, then 20 bits of the id's digest."""
    low = F.conv(F.substring(F.sha2(message_id, 256), 1, 6), 16, 10).cast("long").bitwiseAND(F.lit(0xFFFFF))
    return F.shiftleft(date_utc.cast("long"), 20).bitwiseOR(low)


def message_id(header: Column, subject: Column, date_utc: Column, sender: Column) -> Column:
    """The header's id without spaces and angle brackets, or else a digest of subject, date and sender."""
    own = F.regexp_replace(F.coalesce(header, F.lit("")), r"^[\s<>]+|[\s<>]+$", "")
    iso = F.when(date_utc != 0, F.date_format(F.timestamp_seconds(date_utc), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise("")
    made = F.substring(F.sha2(F.concat_ws("|", F.coalesce(subject, F.lit("")), iso, F.coalesce(sender, F.lit(""))), 256), 1, 32)
    return F.when(own != "", own).otherwise(made)


def snippet(body: Column, length: int = 300) -> Column:
    return F.substring(F.coalesce(body, F.lit("")), 1, length)


def attachment_list(names: Column) -> Column:
    """Names without blanks."""
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.trim(n) != "")


def attachment_text(names: Column) -> Column:
    return F.array_join(names, "; ")


def split_attachments(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "; "), lambda n: n != "")


def address_text(value: str | None) -> str:
    if not value:
        return ""
    found = ((name.strip(), address.strip()) for name, address in getaddresses([value.replace(";", ",")]))
    return "; ".join(f"{n} <{a}>" if n and a else n or a for n, a in found if n or a)


@F.pandas_udf(StringType())
def addresses(value: pd.Series) -> pd.Series:
    """``Name <address>`` of each entry of an address header, joined by ``; ``."""
    return value.map(address_text)


def contains(folded: Column, needle: str) -> Column:
    return F.lit(True) if not needle else F.contains(folded, F.lit(needle))


def is_plain_word(text: str) -> bool:
    return text.isascii() and text.isalnum()


def whole_word(folded: Column, needle: str) -> Column:
    """``needle`` not next to another letter, digit or underscore of ASCII."""
    return folded.rlike(f"(?<![0-9a-z_]){re.escape(needle)}(?![0-9a-z_])")


def highlight(text: Column, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """Every occurrence of a word of two characters or more, in any case, between two marks."""
    words = sorted({w for w in words if len(w) >= 2}, key=lambda w: (-len(w), w))
    if not words:
        return text
    quoted = "|".join(re.escape(w) for w in words)
    return F.regexp_replace(text, f"(?iu)({quoted})", f"{before}$1{after}")


def size_text(size: Column) -> Column:
    """Bytes in steps of 1024: whole below a kilobyte, one decimal from there on."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = F.lit(None).cast("string")
    for power in range(len(units) - 1, -1, -1):
        scaled = size / F.lit(float(1 << (10 * power)))
        digits = 0 if power == 0 else 1
        shown = F.format_string(f"%.{digits}f {units[power]}", F.bround(scaled, digits))
        fits = F.lit(True) if power == len(units) - 1 else size < F.lit(float(1 << (10 * (power + 1))))
        out = shown if power == len(units) - 1 else F.when(fits, shown).otherwise(out)
    return out


def count_text(count: Column, cap: int = 1000) -> Column:
    return F.when(count >= cap, F.lit(f"{cap}+건")).otherwise(F.concat(count.cast("string"), F.lit("건")))


def day(date_utc: Column) -> Column:
    return F.date_format(F.timestamp_seconds(date_utc), "yyyy-MM-dd")


def short_time(date_utc: Column) -> Column:
    return F.date_format(F.timestamp_seconds(date_utc), "MM-dd HH:mm")


def full_time(date_utc: Column) -> Column:
    return F.date_format(F.timestamp_seconds(date_utc), "yyyy-MM-dd HH:mm:ss")

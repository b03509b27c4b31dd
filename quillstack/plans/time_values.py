"""Date and size values of the query language; pure functions of the text and of ``now``."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

Range = tuple[int | None, int | None]
NOTHING: Range = (None, None)
DAY = 86_400

#: The named periods, in English and Korean.
NAMED = {
    "today": "today",
    "오늘": "today",
    "yesterday": "yesterday",
    "어제": "yesterday",
    "thisweek": "thisweek",
    "이번주": "thisweek",
    "lastweek": "lastweek",
    "지난주": "lastweek",
    "thismonth": "thismonth",
    "이번달": "thismonth",
    "thisyear": "thisyear",
    "올해": "thisyear",
}
UNIT_DAYS = {"d": 1, "m": 30, "y": 365}
SIZE_UNITS = {"b": 0, "kb": 10, "mb": 20, "gb": 30}


def _epoch(year: int, month: int = 1, day: int = 1) -> int:
    return int(datetime(year, month, day, tzinfo=timezone.utc).timestamp())


def _month(year: int, month: int) -> Range:
    following = (year + month // 12, month % 12 + 1)
    return _epoch(year, month), _epoch(*following)


def _named(name: str, now: datetime) -> Range:
    midnight = _epoch(now.year, now.month, now.day)
    monday = midnight - now.weekday() * DAY
    return {
        "today": lambda: (midnight, midnight + DAY),
        "yesterday": lambda: (midnight - DAY, midnight),
        "thisweek": lambda: (monday, monday + 7 * DAY),
        "lastweek": lambda: (monday - 7 * DAY, monday),
        "thismonth": lambda: _month(now.year, now.month),
        "thisyear": lambda: (_epoch(now.year), _epoch(now.year + 1)),
    }[name]()


def date_range(value: str, now: datetime) -> Range:
    """Half-open epoch range of a date expression; ``NOTHING`` if it isn't one.

    A year, month or day covers that period; ``A..B`` runs to the end of B's period; ``7d``, ``3m`` and
    ``1y`` reach back from ``now`` and are open at the end.  Impossible dates count as no date.
    """
    text = value.strip().lower()
    try:
        if ".." in text:
            low, _, high = text.partition("..")
            start, (b_start, b_end) = date_range(low, now)[0], date_range(high, now)
            return start, b_start if b_end is None else b_end
        if text in NAMED:
            return _named(NAMED[text], now.astimezone(timezone.utc))
        if back := re.fullmatch(r"([0-9]+)([dmy])", text):
            days = int(back[1]) * UNIT_DAYS[back[2]]
            return int((now - timedelta(days=days)).timestamp()), None
        if not re.fullmatch(r"[0-9]{4}(-[0-9]{2}){0,2}", text):
            return NOTHING
        parts = [int(x) for x in text.split("-")]
        if len(parts) == 1:
            return _epoch(parts[0]), _epoch(parts[0] + 1)
        if len(parts) == 2:
            return _month(*parts)
        return _epoch(*parts), _epoch(*parts) + DAY
    except (ValueError, OverflowError):
        return NOTHING


def size_filter(value: str) -> tuple[str, int] | None:
    """``(operator, bytes)`` of a size expression such as ``>1MB``; None if it isn't one."""
    found = re.fullmatch(r"(>=|<=|>|<)?\s*([0-9.]+)\s*(b|kb|mb|gb)?", value.strip(), re.IGNORECASE)
    if not found:
        return None
    try:
        number = float(found[2])
    except ValueError:
        return None
    return found[1] or ">=", int(number * (1 << SIZE_UNITS[(found[3] or "b").lower()]))

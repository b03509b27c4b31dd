"""Charset decoding that never fails, and previews of what could not be decoded."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

OK, FALLBACK, FAILED = "ok", "fallback", "failed"
GUESS_CONFIDENCE = 0.6
DECODED = StructType([StructField("text", StringType()), StructField("status", StringType())])


def _guess(raw: bytes) -> str | None:
    """The encoding that chardet proposes, if it is there and sure enough."""
    try:
        import chardet
    except ImportError:
        return None
    found = chardet.detect(raw)
    return found["encoding"] if (found.get("confidence") or 0) >= GUESS_CONFIDENCE else None


def decode_bytes(raw: object) -> tuple[str, str]:
    """``(text, status)``: UTF-8, then a guess, then the two Korean code pages; at last every byte becomes a character."""
    if not isinstance(raw, (bytes, bytearray)):
        return "", FAILED
    raw = bytes(raw)
    try:
        return raw.decode("utf-8"), OK
    except UnicodeDecodeError:
        pass
    for name in (_guess(raw), "cp949", "euc-kr"):
        try:
            if name:
                return raw.decode(name), FALLBACK
        except (UnicodeDecodeError, LookupError):
            continue
    return raw.decode("latin-1"), FAILED


@F.pandas_udf(DECODED)
def _decode_slow(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([decode_bytes(x) for x in raw], columns=["text", "status"])


def decode(raw: Column) -> Column:
    """Struct ``(text, status)`` of a binary column; a null has failed."""
    return _decode_slow(raw)


def inflate_bytes(raw: object) -> str:
    if not isinstance(raw, (bytes, bytearray)):
        return ""
    try:
        return zlib.decompress(raw).decode("utf-8", "replace")
    except zlib.error:
        return ""


@F.pandas_udf(StringType())
def inflate(raw: pd.Series) -> pd.Series:
    """Text of a zlib-packed body, as other stores keep it; empty if it is null or damaged."""
    return raw.map(inflate_bytes)


def preview(raw: Column, most: int = 256 * 1024) -> Column:
    """Base64 of the first ``most`` bytes."""
    return F.regexp_replace(F.base64(F.substring(raw, 1, most)), r"\s", "")


def preview_cut(raw: Column, most: int = 256 * 1024) -> Column:
    return F.octet_length(raw) > most

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions import decode as D
from quillstack.functions import mime as M
from quillstack.functions import text as X


def evaluate(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "body, kept",
    [
        ("hi\n-----Original Message-----\nold", "hi\n"),
        ("hi\n  ---- 원본 메시지 ----\nold\nmore", "hi\n"),
        ("a\n> q\n | r\nb", "a\nb"),
        ("1 > 2", "1 > 2"),
        ("", ""),
        (None, ""),
        ("x\n--original message--", "x\n"),
    ],
)
def test_strip_quoted(spark, body, kept):
    assert evaluate(spark, X.strip_quoted, body) == kept


def test_bigrams_agree_with_the_definition(spark):
    rng = random.Random(5)
    alphabet = "ab1 .,é가나ㄱ\n_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", X.bigrams(F.col("v")).alias("g"), X.bigram_count(F.col("v")).alias("n")).collect()
    for r in rows:
        expected = X.bigrams_of(r["v"]) if X.fold_text(r["v"]) == r["v"] else None
        if expected is not None:
            assert (r["g"], r["n"]) == (expected, len(expected)), r["v"]


def test_occurrences_overlap(spark):
    assert evaluate(spark, lambda c: X.occurrences(c, "aa"), "aaaa baa") == 4
    assert evaluate(spark, lambda c: X.occurrences(c, "ab"), "abab b ab") == 3


def test_fold_is_exact(spark):
    for value in ("ＡＢ Straße", "ﬁne", "ㅋㅋ", "É", None, "plain"):
        assert evaluate(spark, X.fold, value) == X.fold_text(value or "")


def test_row_key(spark):
    key = spark.createDataFrame([(1700000000, "m1")], "d long, m string").select(X.row_key(F.col("d"), F.col("m"))).first()[0]
    assert key == 1782579200658930


def test_message_id(spark):
    df = spark.createDataFrame([(" <a@b> ", "s", 1704067200, "f"), ("", "s", 1704067200, "f"), (None, "s", 0, "f")], "h string, s string, d long, f string")
    own, made, undated = (r[0] for r in df.select(X.message_id(F.col("h"), F.col("s"), F.col("d"), F.col("f"))).collect())
    assert own == "a@b" and len(made) == 32 and made != undated


@pytest.mark.parametrize(
    "value, expected",
    [("a@b.c", "a@b.c"), ('"Kim, Y" <k@x>; b@y', "Kim, Y <k@x>; b@y"), ("", ""), (None, ""), ("Name <n@x>, m@y", "Name <n@x>; m@y")],
)
def test_addresses(spark, value, expected):
    assert evaluate(spark, X.addresses, value) == expected


def test_whole_word_and_highlight(spark):
    assert evaluate(spark, lambda c: X.whole_word(c, "con"), "a con-b")
    assert not evaluate(spark, lambda c: X.whole_word(c, "con"), "contract acon con_x")
    assert evaluate(spark, lambda c: X.highlight(c, ["Con", "x"]), "a con CONx") == "a <em>con</em> <em>CON</em>x"


@pytest.mark.parametrize("size, shown", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (5 << 20, "5.0 MB"), (3 << 50, "3.0 PB"), (2048 << 50, "2048.0 PB")])
def test_size_text(spark, size, shown):
    assert evaluate(spark, X.size_text, size, "long") == shown


def test_attachment_lists(spark):
    assert evaluate(spark, X.attachment_list, ["a", " ", "", "b"], "array<string>") == ["a", "b"]
    assert evaluate(spark, X.split_attachments, "a; b; ") == ["a", "b"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("한글".encode(), ("한글", "ok")),
        ("한글 문서".encode("cp949"), ("한글 문서", "fallback")),
        (b"", ("", "ok")),
        (b"\xff\xfe\x00\x01\x80\x81", ("ÿþ\x00\x01\x80\x81", "failed")),
    ],
)
def test_decode(spark, raw, expected):
    got = evaluate(spark, D.decode, raw, "binary")
    assert (got["text"], got["status"]) == expected


def test_decode_of_what_is_no_bytes(spark):
    assert D.decode_bytes(None) == D.decode_bytes(12345) == ("", "failed")
    assert evaluate(spark, D.decode, None, "binary")["status"] == "failed"


def test_inflate(spark):
    import zlib

    assert evaluate(spark, D.inflate, zlib.compress("본문".encode()), "binary") == "본문"
    assert evaluate(spark, D.inflate, b"damaged", "binary") == evaluate(spark, D.inflate, None, "binary") == ""


def test_preview(spark):
    assert evaluate(spark, lambda c: D.preview(c, 10), b"x" * 1000, "binary") == "eHh4eHh4eHh4eA=="
    assert evaluate(spark, lambda c: D.preview_cut(c, 10), b"x" * 1000, "binary")


def test_headers_and_dates():
    block = "Subject: a\r\n b\r\nX: 1\r\nsubject: later\r\nbroken"
    assert M.header_map(block) == {"subject": "a b", "x": "1"}
    assert M.epoch(None, "Mon, 01 Jan 2024 09:00:00 +0900") == 1704067200
    assert M.epoch(None, "Mon, 01 Jan 2024 00:00:00") == 1704067200
    assert M.epoch(None, "nonsense") == M.epoch(None, None) == 0


def test_mime():
    from email.message import EmailMessage

    m = EmailMessage()
    m.set_content("plain\r\ntext")
    m.add_alternative("<p>html</p>", subtype="html")
    m.add_attachment(b"pdf", maintype="application", subtype="pdf", filename="계약서.pdf")
    row = M.raw_record(bytes(m), "f", "Inbox", "{}")
    assert row["body_bytes"].startswith(b"plain") and b"html" in row["html_bytes"] and row["attachment_names"] == ["계약서.pdf"]
    plain = M.raw_record(b"Subject: s\r\n\r\na\r\nb", "f", "", "{}")
    assert plain["body_bytes"] == b"a\r\nb" and plain["attachment_names"] == []

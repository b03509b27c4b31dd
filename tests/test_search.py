from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillstack.functions.text import fold_text
from quillstack.model import MAILS_SCHEMA
from quillstack.operators import search
from quillstack.plans.compile import FOLDED, with_search_columns
from quillstack.plans.query_language import Either, parse


def mail(name, subject, body, sender, date, attachment="", folder="Inbox", to="b@corp.com", cc=""):
    names = [attachment] if attachment else []
    return (None, name, "a.pst", folder, sender, to, cc, date, subject, body[:300], bool(names), names, len(body), body, None, "ok", 0, "")


def table(spark, rows):
    from quillstack.functions.text import row_key

    df = spark.createDataFrame(rows, MAILS_SCHEMA).withColumn("rowid", row_key(F.col("date_utc"), F.col("message_id")))
    return with_search_columns(df).cache()


@pytest.fixture(scope="module")
def populated(spark):
    return table(
        spark,
        [
            mail("m1", "Q3 계약서 검토 요청", "올해 계약 관련 문서입니다", "김영수 <ys.kim@corp.co.kr>", 1700000000, "계약서.pdf"),
            mail("m2", "회의록", "내일 회의 일정 공지", "carol@corp.com", 1701000000),
            mail("m3", "AI QA report", "naive cafe report. contract review needed.", "eve@corp.com", 1702000000, "report.docx"),
            mail("m4", "personal note", "config file update", "ivy@corp.com", 1703000000),
        ],
    )


def ids(result):
    return {r["message_id"] for r in result.hits.collect()}


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("계약 검토", {"m1"}),
        ("subject:계약", {"m1"}),
        ("con", {"m3", "m4"}),
        ("hasattachment:yes", {"m1", "m3"}),
        ("after:2999-01-01", set()),
        ("계약 OR 회의록", {"m1", "m2"}),
        ("report NOT contract", set()),
        ("-from:eve con", {"m4"}),
        ('계약" OR 1=1 --', set()),
        ("AI", {"m3"}),
        ("", {"m1", "m2", "m3", "m4"}),
    ],
)
def test_search(populated, raw, expected):
    assert ids(search.search(populated, raw)) == expected


def test_single_characters_search_with_a_warning(populated):
    result = search.search(populated, "a")
    assert ids(result) == {"m3", "m4", "m1", "m2"} or result.warnings
    assert result.warnings


def test_whole_word_that_leaves_nothing_warns(populated):
    result = search.search(populated, "con", whole_word=True)
    assert not ids(result) and any("whole-word" in w for w in result.warnings)


def test_zero_hits_are_diagnosed(populated):
    result = search.search(populated, "계약 존재하지않는단어 hasattachment:yes")
    assert [(p.label, p.count, p.culprit) for p in result.diagnosis] == [("계약", "1건", False), ("존재하지않는단어", "0건", True), ("hasattachment:yes", "2건", False)]


def test_newest_first_and_paging(populated):
    result = search.search(populated, "", limit=2)
    rows = result.hits.collect()
    assert [r["message_id"] for r in rows] == ["m4", "m3"] and result.more_available
    following = search.search(populated, "", limit=2, below=rows[-1]["rowid"])
    assert [r["message_id"] for r in following.hits.collect()] == ["m2", "m1"] and not following.more_available


def test_relevance(populated):
    result = search.search(populated, "con", sort="relevance")
    scores = [r["score"] for r in result.hits.collect()]
    assert scores == sorted(scores) and len(scores) == 2
    assert search.search(populated, "가", sort="relevance").warnings


def test_folders(spark):
    t = table(spark, [mail("f1", "s", "b", "x@y", 1, folder="받은편지함"), mail("f2", "s", "b", "x@y", 2, folder="받은편지함/법무"), mail("f3", "s", "b", "x@y", 3, folder="받은편지함/법무/2024"), mail("f4", "s", "b", "x@y", 4, folder="보낸편지함"), mail("f5", "s", "b", "x@y", 5, folder="")])
    assert ids(search.search(t, "folder:법무")) == {"f2", "f3"}
    assert ids(search.search(t, "folder:받은편지함")) == {"f1", "f2", "f3"}
    assert ids(search.search(t, "folder:법무 OR folder:보낸편지함")) == {"f2", "f3", "f4"}
    assert ids(search.search(t, "", folders=["받은편지함"])) == {"f1"}
    assert [r[0] for r in search.list_folders(t).collect()] == ["받은편지함", "받은편지함/법무", "받은편지함/법무/2024", "보낸편지함"]
    assert search.list_folders(t.limit(0)).count() == 0


def test_the_predicate_agrees_with_plain_python(spark):
    rng = random.Random(11)
    words = ["계약", "계약서", "contract", "con", "é", "Q3", "a", "report", "straße", "x y", "1>2"]
    rows = [mail(f"r{i}", " ".join(rng.choices(words, k=3)), "\n".join(rng.choices(words, k=5)), rng.choice(["a@b", "Kim <k@c>"]), 1700000000 + i, rng.choice(["", "f.pdf"])) for i in range(60)]
    t = table(spark, rows)
    texts = {r["message_id"]: r for r in t.select("message_id", *FOLDED.values(), "f_all").collect()}

    def holds(c, r):
        if isinstance(c, Either):
            return holds(c.left, r) or holds(c.right, r)
        found = fold_text(c.text) in r[FOLDED[c.field] if c.field else "f_all"]
        return found != c.negated

    for _ in range(25):
        raw = " ".join(rng.choice(["", "NOT ", "-"]) + rng.choice(["", "subject:", "body:"]) + f'"{rng.choice(words)}"' for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.4:
            raw += f" OR {rng.choice(['con', 'a'])}"
        q = parse(raw)
        expected = {m for m, r in texts.items() if all(holds(c, r) for c in q.clauses)}
        assert {r[0] for r in search.matches(t, q).select("message_id").collect()} == expected, raw


def test_filters_reach_the_scan(spark, populated, tmp_path, capsys):
    path = str(tmp_path / "mails")
    populated.write.parquet(path)
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    search.top(search.matches(spark.read.parquet(path), parse("con after:2023-01-01")), 5).select("message_id").explain("formatted")
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    plan = capsys.readouterr().out
    assert "StringContains(f_all,con)" in plan and "GreaterThanOrEqual(date_utc" in plan and "TakeOrderedAndProject" in plan

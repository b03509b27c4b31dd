from __future__ import annotations

import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstack.config import Settings
from quillstack.functions import text as X
from quillstack.model import MAILS_SCHEMA
from quillstack.operators import blocks, export, indexed, keys, rank, search, store
from quillstack.operators.normalize import errors, normalize
from quillstack.operators.store import MailStore, StateLog
from quillstack.plans.compile import FOLDED
from quillstack.sources.discovery import choose_reader, containers, discover, optional_module
from quillstack.sources.mailbox import read_containers, read_eml
from quillstack.sources.readers import fetch_attachment
from quillstack.streaming import ingest

OPTIONS = {"reader": "fake", "plugins": "fake_reader"}


@pytest.fixture
def boxes(tmp_path):
    def write(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.pst").write_text(text)
        return str(tmp_path)

    return write


def test_discovery(tmp_path):
    for name in ("a.pst", "nested/b.pst", "c.ost", "ignore.txt", "mails/x.msg", "mails/y.msg"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("")
    names = lambda found: [os.path.relpath(x, tmp_path) for x in found]
    assert names(discover([str(tmp_path)])) == ["a.pst", "c.ost"]
    assert names(discover([str(tmp_path)], True)) == ["a.pst", "c.ost", "mails", "nested/b.pst"]
    assert names(discover([str(tmp_path / "*.pst")])) == ["a.pst"]
    assert names(discover([str(tmp_path / "a.pst"), str(tmp_path / "*.pst")])) == ["a.pst"]


def test_listing_by_spark_equals_the_local_walk(spark, tmp_path):
    for n, name in enumerate(("a.pst", "nested/b.PST", "nested/deep/c.ost", "ignore.txt", "mails/x.msg", "mails/sub/y.msg", "mails/sub/note.txt", "mails/sub/z.pst", "sp ace/é%20.pst", "empty/none.txt", "br[ack]et {x}/w.pst")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True, parents=True)
        p.write_text("x" * (n + 1))
    sizes = lambda path: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names) if os.path.isdir(path) else os.path.getsize(path)
    for paths in ([""], ["a.pst", "*.pst"], ["nested", "mails"], ["mails/x.msg"], ["missing", "ignore.txt"], ["*"], ["nested/**/*.ost"], ["br?ack?et*"]):
        for recursive in (False, True):
            if "**" in paths[0] and not recursive:
                continue
            given = [str(tmp_path / p) for p in paths]
            got = {r["path"]: r for r in containers(spark, given, recursive).collect()}
            assert sorted(got) == discover(given, recursive), (paths, recursive)
            for path, r in got.items():
                assert r["size"] == sizes(path) and r["mtime"] > 1e9


def test_reader_choice():
    none, all_of = (lambda name: None), (lambda name: object())
    assert choose_reader("x.PST", all_of, none) == "libpff"
    assert choose_reader("x.ost", none, all_of) == "readpst"
    assert choose_reader("x.pst", none, none) is None
    assert choose_reader("x.msg", all_of, none) == "extract_msg"
    assert optional_module("no_such_module_at_all") is None


def test_normalize(spark, boxes):
    raw = read_containers(spark, [boxes(a="FAKE:5,BADMSG")], **OPTIONS)
    rows = {r["locator_json"]: r for r in normalize(raw, now=7).collect()}
    assert len(rows) == 4
    first = rows[json.dumps({"reader": "fake", "index": 0})]
    assert first["date_utc"] == 1704067200 and first["has_attachment"] and first["attachment_names"] == ["계약서.pdf"]
    assert first["decode_status"] == "ok" and first["body"] == "본문 0" and first["snippet"] == "본문 0" and first["indexed_at"] == 7
    third = rows[json.dumps({"reader": "fake", "index": 3})]
    assert third["decode_status"] == "fallback" and third["body"] == "본문 3" and third["raw_body_b64"] is None
    assert [(r["error_type"], r["folder_path"]) for r in errors(raw).collect()] == [("AttributeError", "Inbox")]


def test_index_and_rerun(spark, boxes, tmp_path):
    events = []
    root = boxes(a="FAKE:20", b="FAKE:15", broken="CORRUPT")
    mails = MailStore(spark, str(tmp_path / "store"))
    got = ingest.index(spark, mails, [root], on_event=lambda kind, info: events.append(kind), **OPTIONS)
    assert (got["completed"], got["failed"], got["written"], got["errors"]) == (2, 1, 35, 1)
    assert mails.mails().count() == 35 and {"resolved", "batch", "errors", "done", "failed"} <= set(events)
    assert mails.recent_errors().count() == 1
    again = ingest.index(spark, mails, [root], **OPTIONS)
    assert (again["skipped"], again["completed"], again["failed"]) == (2, 0, 1)
    assert mails.mails().count() == 35
    assert {(r["status"], r["files"], r["mails"]) for r in store.summary(mails.state().frame()).collect()} == {("COMPLETED", 2, 35), ("FAILED", 1, 0)}
    assert search.search(mails.mails(), "계약서", limit=50).hits.count() == 35


def test_upserts(spark, boxes, tmp_path):
    raw = read_containers(spark, [boxes(a="FAKE:6")], **OPTIONS)
    mails = MailStore(spark, str(tmp_path / "store"))
    batch = normalize(raw, now=1)
    assert vars(mails.upsert(batch)) == {"inserted": 6, "updated": 0}
    assert vars(mails.upsert(batch)) == {"inserted": 0, "updated": 6}
    changed = batch.limit(1).withColumn("subject", F.lit("changed"))
    mails.upsert(changed.unionByName(batch.limit(1)).withColumn("file_path", F.when(F.col("subject") == "changed", "z").otherwise("a")))
    assert mails.mails().count() == 6 and mails.mails().filter("subject = 'changed'").count() == 1


def test_an_upsert_writes_only_what_is_new(spark, boxes, tmp_path):
    batch = normalize(read_containers(spark, [boxes(a="FAKE:4")], **OPTIONS), now=1)
    spread = batch.withColumn("date_utc", F.when(F.col("locator_json").contains("1"), 1709251200).otherwise(F.col("date_utc")).cast("long"))
    mails = MailStore(spark, str(tmp_path / "store"))
    mails.upsert(spread)
    assert mails.months() == ["2024-01", "2024-03"] and mails.mails().count() == 4
    keys = {r["message_id"]: r["rowid"] for r in mails.mails().collect()}
    mails.upsert(spread.filter("date_utc >= 1709251200").withColumn("subject", F.lit("late")))
    first, second = mails.snapshot().segments
    assert set(second["months"]) == {"2024-03"} and (second["rows"], second["gone"]) == (1, 1) and first["rows"] == 4
    assert {r["message_id"]: r["rowid"] for r in mails.mails().collect()} == keys
    mails.upsert(spread.filter("date_utc >= 1709251200").withColumn("date_utc", F.lit(1704067200).cast("long")))  # moves to January
    assert mails.mails().filter("month = '2024-03'").count() == 0 and mails.mails().count() == 4
    assert mails.compact(everything=True) and mails.months() == ["2024-01"] and len(mails.snapshot().segments) == 1
    left = tmp_path / "store" / "drafts" / "000000000000001-dead"
    left.mkdir(parents=True, exist_ok=True)
    assert mails.vacuum(-1) == 3 and mails.mails().count() == 4 and not left.exists()
    assert vars(mails.upsert(spread.filter("false"))) == {"inserted": 0, "updated": 0} and mails.version() == 4
    assert sorted(os.listdir(tmp_path / "store" / "data")) == [f"seg={mails.snapshot().segments[0]['id']}"]
    found = search.matches(mails.mails(), search.parse("after:2024-01-01 before:2024-02-01"))
    assert found.count() == 4 and "PartitionFilters: [" in found._jdf.queryExecution().toString()
    assert not mails.compact(everything=True)


def drafts(spark, tmp_path):
    return MailStore(spark, str(tmp_path / "keys"))._drafts(str(tmp_path / "keys" / "drafts"))


def plain_keys(rows, taken=()):
    used, out = set(taken), {}
    for base, i in sorted((b, i) for i, b in rows):
        while base in used:
            base += 1
        used.add(base)
        out[i] = base
    return out


@pytest.mark.parametrize("seed", range(4))
def test_no_two_keys_are_alike(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(f"m{i}", rng.choice([7, 100, rng.randrange(400)])) for i in range(300)]
    taken = [set(), {8}, set(range(5, 60)) | {100, 900}, {rng.randrange(700) for _ in range(300)}][seed]
    df = spark.createDataFrame(rows, "message_id string, base long").repartition(3)
    got = keys.allocate(df, F.col("base"), drafts(spark, tmp_path), spark.createDataFrame([(t,) for t in taken], "rowid long") if taken else None)
    assert {r["message_id"]: r["rowid"] for r in got.collect()} == plain_keys(rows, taken)


def test_two_million_undated_messages_have_as_many_keys(spark, tmp_path):
    rows = spark.range(2_000_000).select(F.concat(F.lit("m"), "id").alias("message_id"), F.lit(0).cast("long").alias("date_utc"))
    got = keys.allocate(rows, X.row_key(F.col("date_utc"), F.col("message_id")), drafts(spark, tmp_path))
    facts = got.agg(F.count("*").alias("n"), F.count_distinct("rowid").alias("keys"), F.max("rowid").alias("last")).first()
    assert facts["n"] == facts["keys"] == 2_000_000 and facts["last"] < 2_000_100


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, boxes, tmp_path, monkeypatch):
    batch = normalize(read_containers(spark, [boxes(a="FAKE:4")], **OPTIONS), now=1)
    mails = MailStore(spark, str(tmp_path / "store"))
    mails.upsert(batch)

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # between the draft of the pointer and its name
        m.setattr(type(mails.files), "_rename", dies)
        with pytest.raises(RuntimeError, match="killed"):
            mails.upsert(batch.withColumn("subject", F.lit("lost")))
    other = MailStore(spark, str(tmp_path / "store"))
    assert other.mails().count() == 4 and other.mails().filter("subject = 'lost'").count() == 0
    assert vars(other.upsert(batch.withColumn("subject", F.lit("kept")))) == {"inserted": 0, "updated": 4}
    assert mails.mails().filter("subject = 'kept'").count() == 4 and mails.version() == 2


def test_of_two_writers_the_later_one_starts_over(spark, boxes, tmp_path, monkeypatch):
    batch = normalize(read_containers(spark, [boxes(a="FAKE:4")], **OPTIONS), now=1)
    a, b = (MailStore(spark, str(tmp_path / "store"), Settings(retry_backoff_seconds=(0.0,))) for _ in range(2))
    a.upsert(batch.limit(1))
    create, lost = a.files.create, []

    def after_another(path, text):
        if not lost:
            lost.append(path)
            b.upsert(batch.withColumn("message_id", F.concat("message_id", F.lit("-b"))))
        return create(path, text)

    monkeypatch.setattr(a.files, "create", after_another)
    assert vars(a.upsert(batch)) == {"inserted": 3, "updated": 1}
    assert a.mails().count() == 8 and a.version() == 3


def plain_postings(mails):
    """``(gram, field, rowid, tf)`` by the expressions that queries use."""
    out = {}
    for r in mails.select("rowid", *FOLDED.values()).collect():
        for field, column in FOLDED.items():
            for g in X.bigrams_of(r[column]):
                out[g, field, r["rowid"]] = out.get((g, field, r["rowid"]), 0) + 1
    return out


def check_index(mails, raws=("계약서", "zebra", "subject:zebra xylo", "zebra NOT xylophone", "nothing here", "a", "", "계약 OR zebra", "계약 계약")):
    now = mails.snapshot()
    want = plain_postings(now.mails())
    got = {(r["gram"], r["field"], r["rowid"]): r["tf"] for r in now.postings().collect()}
    assert got == want
    held, times = {}, {}
    for (g, f, i), n in want.items():
        for field in (f, ""):
            held.setdefault((g, field), set()).add(i)
            times[g, field] = times.get((g, field), 0) + n
    assert {(r["gram"], r["field"]): (r["messages"], r["occurrences"]) for r in now.dictionary().collect()} == {k: (len(v), times[k]) for k, v in held.items()}
    assert (now.rows, now.length) == now.mails().agg(F.count("*"), F.coalesce(F.sum("n_grams"), F.lit(0))).first()
    for raw in raws:
        q = search.parse(raw)
        found = [sorted(r[0] for r in search.matches(now.mails(), q, index=i).select("rowid").collect()) for i in (None, now)]
        assert found[0] == found[1], raw
        grams = rank.query_grams(q)
        assert not grams or rank.stats(now.mails(), grams) == rank.stats_from_index(now, grams)
        for sort in ("relevance", "date"):
            a, b = (search.search(now.mails(), raw, sort=sort, limit=7, index=i) for i in (None, now))
            assert a.hits.collect() == b.hits.collect() and a.more_available == b.more_available, (raw, sort)


def test_the_index_follows_the_store(spark, boxes, tmp_path, monkeypatch):
    monkeypatch.setattr(indexed, "WORTH", 0)
    root = boxes(a="FAKE:20", b="FAKE:15")
    mails = MailStore(spark, str(tmp_path / "store"))
    mails.upsert(normalize(read_containers(spark, [root], **OPTIONS), now=1))
    mails.upsert(mails.mails().select(*MAILS_SCHEMA.fieldNames()).limit(3).withColumn("subject", F.lit("zebra xylophone")))
    check_index(mails)


def made(spark, rows):
    """Messages ``(id, date, subject, body, container)``."""
    df = spark.createDataFrame(rows, "message_id string, date_utc long, subject string, body string, file_path string")
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MAILS_SCHEMA.fields))


def test_upserts_equal_a_model(spark, tmp_path, monkeypatch):
    """Random upserts, with moves, repeats and merges of segments, against a dictionary."""
    monkeypatch.setattr(store, "SMALL", 6)
    monkeypatch.setattr(store, "FANOUT", 3)
    monkeypatch.setattr(blocks, "SLICE", 4)
    monkeypatch.setattr(indexed, "WORTH", 0)
    monkeypatch.setattr(indexed, "OPENED", 1)
    rng, model = random.Random(11), {}
    words = ["zebra", "xylophone", "계약서", "가나", "aa", "banana", "é", "q"]
    mails, most = MailStore(spark, str(tmp_path / "store")), 0
    for step in range(7):
        ids = [f"m{rng.randrange(40)}" for _ in range(12 if step % 3 else 25)]
        rows = [(i, rng.choice([0, 0, 1704067200, 1706900000 + 3000000 * rng.randrange(4)]), " ".join(rng.choices(words, k=3)), " ".join(rng.choices(words, k=rng.randrange(30))), f"{step}-{k}") for k, i in enumerate(ids)]
        last = {i: (i, d, s, b) for i, d, s, b, _ in sorted(rows, key=lambda r: r[4])}
        counts = mails.upsert(made(spark, rows))
        assert (counts.inserted, counts.updated) == (len(last.keys() - model.keys()), len(last.keys() & model.keys()))
        before = {r["message_id"]: (r["date_utc"], r["rowid"]) for r in mails.mails().collect()} if step == 6 else None
        model |= last
        found = mails.mails().collect()
        assert sorted((r["message_id"], r["date_utc"], r["subject"], r["body"]) for r in found) == sorted(model.values())
        assert len({r["rowid"] for r in found}) == len(model)
        most = max(most, len(mails.snapshot().segments))
    assert 1 < most < 6 and mails.version() > 7  # some were merged
    check_index(mails, ("zebra 계약서", "banana NOT xylophone", "subject:aa", "q", "zebra"))
    places = {r["message_id"]: (r["rowid"], r["subject"]) for r in mails.mails().collect()}
    for i in ("m1", "m7", "m39", "absent"):
        got = [(r["rowid"], r["subject"]) for r in mails.snapshot().get(i).collect()]
        assert got == ([places[i]] if i in places else [])
    wanted = spark.createDataFrame([(i,) for i in [*list(places)[:9], "absent"]], "message_id string")
    assert [r["rowid"] for r in mails.snapshot().lookup(wanted).collect()] == sorted((places[i][0] for i in list(places)[:9]), reverse=True)
    assert before is None or {i: k for i, (_, k) in before.items()} == {i: k for i, (k, _) in places.items()}


def folder_bytes(path, seg=""):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if seg in d)


def spread_store(spark, tmp_path, n=4000):
    """Messages every three hours, with words of their own, ``common`` in all and ``quetzal`` in one."""
    mails = MailStore(spark, str(tmp_path / "store"))
    rows = spark.range(n).select(F.concat(F.lit("m"), "id").alias("message_id"), (F.col("id") * 10800 + 1704067200).alias("date_utc"), F.when(F.col("id") == 150, "quetzal").otherwise("plain").alias("subject"), F.concat(F.lit("common "), F.repeat(F.sha2(F.col("id").cast("string"), 512), 3), F.repeat(F.lit(" often"), (F.col("id") % 7 == 3).cast("int") * (F.col("id") / 100).cast("int"))).alias("body"), F.lit("x").alias("file_path"))
    rows = rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in MAILS_SCHEMA.fields))
    mails.upsert(rows)
    return mails, rows


def test_what_one_row_and_one_page_cost(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE", 100)
    mails, rows = spread_store(spark, tmp_path)
    whole = folder_bytes(tmp_path / "store")
    mails.upsert(rows.filter("message_id = 'm7'").withColumn("subject", F.lit("changed")))
    written = folder_bytes(tmp_path / "store", mails.snapshot().segments[-1]["id"])
    assert written < whole / 100, (written, whole)
    now = mails.snapshot()
    order, columns = search.newest_first(), ["rowid", "message_id"]
    months = len(now.months())
    page = indexed.newest(search.matches(now.mails(), search.parse("common")), now, 20, order, columns)
    assert [r["message_id"] for r in page.rows] == [f"m{i}" for i in range(3999, 3979, -1)]
    assert page.opened < months / 4  # as many as have 500 messages; here a month has up to 248
    page = indexed.newest(search.matches(now.mails(), search.parse("quetzal")), now, 20, order, columns)
    assert [r["message_id"] for r in page.rows] == ["m150"] and page.opened == months
    # The best by relevance: the slices with the longest runs of the word suffice.
    q = search.parse("often")
    page = indexed.best(search.matches(now.all_rows(), q), now, q, 5, [F.asc("score"), *order], columns)
    want = search.top(search.matches(now.mails(), q), 5, q, rank.stats(now.mails(), rank.query_grams(q))).select(*columns, "score").collect()
    assert [tuple(r) for r in page.rows] == [tuple(r) for r in want] and 0 < page.opened < page.of / 2
    # A look-up of a rare word reads few rows; a word with a gram that nobody has reads none.
    q = search.parse("quetzal")
    few = indexed.narrowed(search.matches(now.mails(), q), now, q, worth=0)
    assert [r["message_id"] for r in few.collect()] == ["m150"]
    assert "month#" in few._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert rows_scanned(few) * 10 < rows_scanned(search.matches(now.mails(), q))
    assert indexed.narrowed(now.mails(), now, search.parse("xylophone"), worth=0).count() == 0
    result = search.search(now.mails(), "xylophone vivid", index=now)
    assert [(p.label, p.count, p.culprit) for p in result.diagnosis] == [("xylophone", "0건", True), ("vivid", "0건", True)]
    assert rows_scanned(now.get("m3000")) <= 248


def rows_scanned(df):
    """Rows that the scans of messages in the plan have read."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec" and "/data/" in node.relation().location().rootPaths().mkString(","):
            total += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_stream(spark, boxes, tmp_path):
    root = boxes(a="FAKE:4")
    mails = MailStore(spark, str(tmp_path / "store"))
    run = lambda: ingest.start(spark, mails, [root], str(tmp_path / "checkpoint"), **OPTIONS).awaitTermination(60)
    run()
    assert mails.mails().count() == 4
    boxes(b="FAKE:3")
    run()
    assert mails.mails().count() == 7


def test_a_stream_admits_a_bounded_number_of_containers(spark, boxes, tmp_path):
    events, settings = [], Settings(commit_containers=2)
    root = boxes(**{f"b{i}": f"FAKE:{i + 1}" for i in range(5)})
    (tmp_path / "note.txt").write_text("FAKE:9")
    mails = MailStore(spark, str(tmp_path / "store"))
    ingest.start(spark, mails, [root], str(tmp_path / "checkpoint"), settings, on_event=lambda kind, info: events.append((kind, info)), **OPTIONS).awaitTermination(120)
    assert mails.mails().count() == 15 and mails.version() == 3  # two, two and one
    assert [k for k, _ in events].count("done") == 5 and [k for k, _ in events].count("batch") == 3


def test_what_is_committed_stays_when_a_run_ends(spark, boxes, tmp_path, monkeypatch):
    root = boxes(a="FAKE:4", b="FAKE:5", c="FAKE:6")
    mails, settings = MailStore(spark, str(tmp_path / "store")), Settings(commit_containers=1)
    write, calls = ingest.write_batch, []

    def ends(*args):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return write(*args)

    monkeypatch.setattr(ingest, "write_batch", ends)
    with pytest.raises(KeyboardInterrupt):
        ingest.index(spark, mails, [root], settings, **OPTIONS)
    assert mails.mails().count() == 9 and sorted(e["status"] for e in mails.state().frame().collect()) == ["COMPLETED", "COMPLETED", "WRITING"]
    got = ingest.index(spark, mails, [root], settings, **OPTIONS)
    assert (got["skipped"], got["completed"], got["written"]) == (2, 1, 6) and mails.mails().count() == 15


def test_a_container_without_a_reader_fails_with_guidance(spark, boxes, tmp_path):
    mails, events = MailStore(spark, str(tmp_path / "store")), []
    if choose_reader("a.pst"):
        pytest.skip("a reader is installed")
    got = ingest.index(spark, mails, [boxes(a="FAKE:4")], on_event=lambda kind, info: events.append((kind, info)))
    assert (got["completed"], got["failed"], got["skipped"]) == (0, 1, 0)
    entry = mails.state().frame().first()
    assert entry["status"] == "FAILED" and "libpff" in entry["error"] and ("failed", "libpff") in [(k, "libpff" if "libpff" in i.get("error", "") else "") for k, i in events]
    assert ingest.index(spark, mails, [str(tmp_path)])["failed"] == 1  # it is tried again


def test_state_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(StateLog, "FOLD", 4)
    mails = MailStore(spark, str(tmp_path))
    assert mails.state().frame().count() == 0
    state, want, sizes = mails.state(), {}, []
    for step in range(14):
        for p in (f"p{step}", f"p{step % 3}", "é ö"):
            status = ("COMPLETED", "FAILED")[step % 2]
            state.set(p, status, size=step, mtime=step + 0.5, error="e\n" if step % 2 else None)
            want[p] = (status, step, step + 0.5, "e\n" if step % 2 else None)
        state.save()
        state.save()  # nothing new
        sizes += [os.path.getsize(tmp_path / "state" / f) for f in os.listdir(tmp_path / "state") if f == f"log-{step + 1:012d}.json"]
        if step in (0, 5, 13):
            got = {r["path"]: (r["status"], r["size"], r["mtime"], r["error"]) for r in mails.state().frame().collect()}
            assert got == want
    assert max(sizes) < 600 and len([n for n in os.listdir(tmp_path / "state") if not n.startswith(".")]) <= 10
    with pytest.raises(ValueError):
        state.set("p", "NONSENSE")
    (tmp_path / "state" / "log-000000000099.json").write_text("{broken\n")
    os.makedirs(tmp_path / "state" / "base-000000000200")  # of a writer that died
    other = StateLog(spark, mails.files, str(tmp_path / "state"))
    other.set("new", "WRITING", size=1, mtime=2.0)
    other.save()
    assert {r["path"] for r in mails.state().frame().collect()} == {*want, "new"}
    plan = spark.createDataFrame([("p12", 12, 12.9), ("p12x", 1, 1.0), ("p11", 11, 11.5), ("p10", 10, 99.0), ("new", 1, 2.0)], "path string, size long, mtime double")
    assert {r["path"] for r in store.pending(plan, mails.state().frame()).collect()} == {"p12x", "p11", "p10", "new"}


def test_exports(spark, boxes, tmp_path):
    batch = normalize(read_containers(spark, [boxes(a="FAKE:5")], **OPTIONS), now=1).cache()
    out = tmp_path / "x.csv"
    assert export.write_csv_file(batch, str(out)) == 5
    assert out.read_bytes().startswith(b"\xef\xbb\xbf") and len(out.read_text(encoding="utf-8-sig").splitlines()) == 6
    odd = spark.createDataFrame([(i, ['a"b', "x,y", "two\nlines", "plain é", None][i % 5], i % 2 == 0, ["p", "q"][: i % 3]) for i in range(1000)], "rowid long, subject string, has_attachment boolean, attachment_names array<string>")
    columns = ["rowid", "subject", "has_attachment", "attachment_names"]
    assert export.write_csv_file(odd.repartition(7).orderBy(F.desc("rowid")), str(out), columns) == 1000
    with open(out, encoding="utf-8-sig", newline="") as f:
        back = list(csv.reader(f))
    assert back[0] == columns and [int(r[0]) for r in back[1:]] == list(range(999, -1, -1))
    assert back[1:4] == [["999", "", "0", ""], ["998", "plain é", "1", "p; q"], ["997", "two\nlines", "0", "p"]]
    assert export.write_csv_file(odd.filter("false"), str(out), columns) == 0 and out.read_bytes() == b"\xef\xbb\xbf" + ",".join(columns).encode() + b"\r\n"
    assert not [n for n in os.listdir(tmp_path) if "parts" in n or "draft" in n]
    folder = tmp_path / "eml"
    assert export.write_eml(batch, str(folder)) == 5
    back = normalize(read_eml(spark, str(folder)), now=1)
    assert {r[0] for r in back.select("subject").collect()} == {r[0] for r in batch.select("subject").collect()}
    assert {r[0].strip() for r in back.select("body").collect()} == {r[0] for r in batch.select("body").collect()}
    assert len(export.json_rows(batch).collect()) == 5


def test_attachments_and_names(boxes, tmp_path):
    import fake_reader  # noqa: F401

    root = boxes(a="FAKE:3")
    name, content = fetch_attachment(f"{root}/a.pst", json.dumps({"reader": "fake", "index": 2}), 0)
    assert (name, content) == ("계약서.pdf", b"content 2")
    with pytest.raises(ValueError):
        fetch_attachment("x", "", 0)
    saved = export.save_attachment("../../evil/..\\x:y.pdf", b"1", str(tmp_path / "out"))
    assert os.path.dirname(saved) == str(tmp_path / "out")
    assert export.safe_name("a/b" * 60) == ("a_b" * 60)[:80]


def test_retry():
    calls = []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("conflict")
        return "done"

    assert store.retry(action, 3, (0.0,)) == "done"
    with pytest.raises(ValueError):
        store.retry(lambda: (_ for _ in ()).throw(ValueError("other")), 3, (0.0,))

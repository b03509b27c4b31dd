"""The ``mails`` table and its bigram index as levels of immutable segments, the state log and the error log.

An upsert writes one segment and nothing else: its messages by month, sorted by key; blocks of postings and what
they add to and take from the dictionary of grams; a directory from ids to keys and months; and a list of the older
rows that its messages replace.  Readers leave out rows that a later segment lists.  When the newest segments
come to as much as those before them, they are merged into one, so a message is written anew a number of times
that grows with the logarithm of the store.

The next numbered pointer then names the valid segments.  It is written under another name and renamed to a number
that must be free, so readers see one state or the other whole, of two writers the later one starts over, and
a crash at any point leaves the state before.  An upsert that is repeated changes nothing but the levels.  Of rows
with one id the last by container and place wins; a message keeps its key unless its date changes.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions import text as X
from ..model import ERROR_SCHEMA, MAILS_SCHEMA
from ..plans.compile import with_search_columns
from ..shared import batch_rows
from . import blocks as B
from . import keys as K
from .files import Files

STATES = ("PARSING", "WRITING", "COMPLETED", "FAILED")
STATE_SCHEMA = "path string, size long, mtime double, status string, mails_written long, error string, updated_at long"


@dataclass(frozen=True)
class UpsertCounts:
    inserted: int
    updated: int


def last_per_id(mails: DataFrame) -> DataFrame:
    """One row for each ``message_id``: the last by file path, then by locator."""
    order = W.partitionBy("message_id").orderBy(F.desc("file_path"), F.desc("locator_json"), F.desc("indexed_at"))
    return mails.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def retry(action, attempts: int, waits: tuple[float, ...], transient=lambda e: "conflict" in str(e).lower()):
    """Repeats ``action`` after errors that pass by themselves."""
    for n in range(attempts):
        try:
            return action()
        except Exception as e:
            if n + 1 == attempts or not transient(e):
                raise
            time.sleep(waits[min(n, len(waits) - 1)])


#: Segments that are merged together at least, and rows below which sizes do not matter.
FANOUT, SMALL = 4, 1000
#: Rows that an upsert or a lookup names to a scan, which then skips files and row groups; beyond that it joins.
NAMED = 1000
TABLES = ("data", "blocks", "grams", "ids", "gone")
IDS_SCHEMA = "hash long, message_id string, rowid long, month string, date_utc long"
GONE_SCHEMA = "rowid long, month string"


def _schema(fields: str) -> T.StructType:
    return T.StructType.fromDDL(fields)


def among(column: str, numbers: list[int]) -> Column:
    """Whether a column is one of some numbers, as one expression whatever their number."""
    return F.expr(f"{column} in ({', '.join(f'{n}L' for n in sorted(numbers))})") if numbers else F.lit(False)


def named(places: list) -> Column:
    """Whether a row is one of ``places(month, rowid)``; the months choose folders."""
    return F.col("month").isin(sorted({p["month"] for p in places})) & among("rowid", [p["rowid"] for p in places])


def _few(rows: DataFrame) -> list:
    """All rows if they can be named, else more than that."""
    return rows.limit(NAMED + 1).collect()


class Snapshot:
    """One state of a store: what a pointer names."""

    def __init__(self, store: MailStore, version: int):
        self.store, self.spark, self.version = store, store.spark, version
        state = json.loads(store.files.read(f"{store.pointers}/{version:012d}.json")) if version else {}
        self.segments: list[dict] = state.get("segments", [])
        self.rows, self.length = state.get("rows", 0), state.get("length", 0)
        self._ascii: dict | None = None

    def months(self) -> dict[str, int]:
        """Months that have messages, with the greatest key of each."""
        out: dict[str, int] = {}
        for s in self.segments:
            for month, (_, last) in s["months"].items():
                out[month] = max(out.get(month, last), last)
        return out

    def _read(self, table: str, schema: T.StructType, segments: list[dict] | None = None) -> DataFrame:
        """A table of the segments, with ``seq`` of each: later ones are greater."""
        segments = [s for s in (self.segments if segments is None else segments) if table != "gone" or s["gone"]]
        whole = T.StructType([*schema.fields, T.StructField("seg", T.StringType())])
        if not segments:
            return self.spark.createDataFrame([], whole).withColumn("seq", F.lit(0).cast("long")).drop("seg")
        base = f"{self.store.root}/{table}"
        read = self.spark.read.schema(whole).option("basePath", base).parquet(*(f"{base}/seg={s['id']}" for s in segments))
        # The segment is a folder, so this reads nothing.
        number = F.element_at(F.create_map(*(F.lit(x) for s in segments for x in (s["id"], s["seq"]))), F.col("seg"))
        return read.withColumn("seq", number.cast("long")).drop("seg")

    def _live(self, rows: DataFrame) -> DataFrame:
        """``rows(rowid, month, seq, ...)`` without those that a later segment replaces."""
        if not any(s["gone"] for s in self.segments[1:]):
            return rows
        gone = self._read("gone", _schema(GONE_SCHEMA)).select(F.col("rowid").alias("__rowid"), F.col("month").alias("__month"), F.col("seq").alias("__seq"))
        return rows.join(gone, (rows["month"] == gone["__month"]) & (rows["rowid"] == gone["__rowid"]) & (rows["seq"] < gone["__seq"]), "left_anti")

    def all_rows(self, segments: list[dict] | None = None) -> DataFrame:
        """Live messages with ``seq``."""
        return self._live(self._read("data", self.store.schema, segments)).select(*self.store.schema.fieldNames(), "seq")

    def mails(self) -> DataFrame:
        """The current table with its search columns; empty before the first upsert."""
        return self.all_rows().drop("seq")

    def blocks(self, segments: list[dict] | None = None) -> DataFrame:
        """Blocks of postings with ``seq``; they speak of replaced messages too."""
        return self._read("blocks", _schema(B.SCHEMA), segments)

    def postings(self) -> DataFrame:
        """The current bigram index: ``(gram, field, rowid, tf, month)``."""
        return self._live(B.postings(self.blocks(), "month", "seq")).drop("seq")

    def dictionary(self) -> DataFrame:
        """``(gram, field, messages, occurrences)`` of the live messages; field ``''`` is all of them together."""
        each = self._read("grams", _schema(B.DICTIONARY)).groupBy("gram", "field").agg(F.sum("messages").alias("messages"), F.sum("occurrences").alias("occurrences"))
        return each.filter("messages > 0")

    def frequencies(self, grams: list[tuple[str, str | None]]) -> dict[tuple[str, str | None], int]:
        """How many live messages have each gram (in a field); from the dictionary alone.

        Those of ASCII grams are read once a state: there are 36 * 36 grams in 7 places at most.
        """
        held = {}
        plain = [g for g in grams if g[0].isascii()]
        if plain and self._ascii is None:
            ascii_only = self.dictionary().filter(F.col("gram").rlike("^[0-9a-z]{2}$"))
            self._ascii = {(r["gram"], r["field"] or None): r["messages"] for r in ascii_only.collect()}
        held |= {g: (self._ascii or {}).get(g, 0) for g in plain}
        if others := [g for g in grams if not g[0].isascii()]:
            found = self.dictionary().filter(F.col("gram").isin(sorted({g for g, _ in others}))).collect()  # seven rows a gram
            found = {(r["gram"], r["field"] or None): r["messages"] for r in found}
            held |= {g: found.get(g, 0) for g in others}
        return held

    def directory(self) -> DataFrame:
        """``(hash, message_id, rowid, month, date_utc, seq)``: every place that an id has had; the last by ``seq`` is valid."""
        return self._read("ids", _schema(IDS_SCHEMA))

    def locate(self, ids: DataFrame) -> DataFrame:
        """``(message_id, rowid, month, date_utc)`` of those of ``ids(message_id)`` that are there."""
        wanted = ids.select("message_id").distinct().withColumn("hash", F.xxhash64("message_id"))
        few = _few(wanted)
        found = self.directory()
        if len(few) <= NAMED:  # statistics and Bloom filters of the directory leave out what cannot have them
            found = found.filter(among("hash", [r["hash"] for r in few]) & F.col("message_id").isin([r["message_id"] for r in few]))
        else:
            found = found.join(wanted, ["hash", "message_id"], "left_semi")
        last = F.max_by(F.struct("rowid", "month", "date_utc"), "seq").alias("x")
        return found.groupBy("message_id").agg(last).select("message_id", "x.*")

    def get(self, message_id: str) -> DataFrame:
        """The message with an id: a look into the directory, then one key of one month."""
        places = self.locate(self.spark.createDataFrame([(message_id,)], "message_id string")).collect()
        return self.at(places)

    def at(self, places: list) -> DataFrame:
        """Messages at named ``(month, rowid)``."""
        return self.mails().filter(named(places))

    def lookup(self, ids: DataFrame) -> DataFrame:
        """The messages of ``ids(message_id)``, newest first."""
        places = self.locate(ids).select("month", "rowid")
        few = _few(places)
        found = self.at(few) if len(few) <= NAMED else self.mails().join(places, ["month", "rowid"], "left_semi")
        return found.orderBy(F.desc("rowid"))


class MailStore:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.root, self.settings, self.files = spark, root.rstrip("/"), settings or Settings(), Files(spark)
        self.pointers = f"{self.root}/pointers"
        self._seen: Snapshot | None = None

    def version(self) -> int:
        """The number of the newest pointer; 0 before the first upsert."""
        return max((int(n[:-5]) for n in self.files.names(self.pointers) if re.fullmatch(r"\d+\.json", n)), default=0)

    def snapshot(self) -> Snapshot:
        """The newest state."""
        version = self.version()
        if self._seen is None or self._seen.version != version:
            self._seen = Snapshot(self, version)
        return self._seen

    def months(self) -> list[str]:
        return sorted(self.snapshot().months())

    @cached_property
    def schema(self) -> T.StructType:
        """Of messages with their search columns; the month, a folder, comes last."""
        return with_search_columns(self.spark.createDataFrame([], MAILS_SCHEMA), self.settings.strip_quoted_replies).schema

    def mails(self) -> DataFrame:
        return self.snapshot().mails()

    def postings(self) -> DataFrame:
        return self.snapshot().postings()

    def upsert(self, updates: DataFrame) -> UpsertCounts:
        counts = retry(lambda: self._upsert(updates), self.settings.retry_max_attempts, self.settings.retry_backoff_seconds)
        self.compact()
        return counts

    def _drafts(self, folder: str):
        """A function that writes frames below ``folder`` and reads them back."""

        def write(df: DataFrame, name: str) -> DataFrame:
            path = f"{folder}/{name}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)

        return write

    def _upsert(self, updates: DataFrame) -> UpsertCounts:
        now, seg = self.snapshot(), f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/drafts/{seg}"
        write = self._drafts(folder)
        try:
            # The new rows are normalised once; what follows reads them back.
            fresh = write(with_search_columns(last_per_id(updates).select(*MAILS_SCHEMA.fieldNames()), self.settings.strip_quoted_replies), "fresh").drop("rowid")
            known = write(now.locate(fresh), "known") if now.segments else None
            new, kept = fresh, None
            if known is not None:
                same = known.select("message_id", "date_utc", "rowid")
                kept = fresh.select("message_id", "date_utc").join(same, ["message_id", "date_utc"]).select("message_id", "rowid")
                new = fresh.join(kept, "message_id", "left_anti")
            base = X.row_key(F.col("date_utc"), F.col("message_id"))
            keys = K.allocate(new.select("message_id", "date_utc"), base, write, now.mails().select("rowid") if known is not None else None).select("message_id", "rowid")
            keys = keys if kept is None else keys.unionByName(kept)
            rows = fresh.join(keys, "message_id").select(*self.schema.fieldNames())
            segment = self._write(seg, rows, known.select("rowid", "month") if known is not None else None, now)
        except BaseException:
            self._drop(seg)
            raise
        finally:
            self.files.delete(folder)
        updated = segment["gone"]
        if not segment["rows"]:
            self._drop(seg)
            return UpsertCounts(0, 0)
        after = {"segments": [*now.segments, {k: segment[k] for k in ("id", "seq", "rows", "gone", "months")}], "rows": now.rows + segment["rows"] - updated, "length": now.length + segment["length"]}
        self._publish(now, after, seg)
        return UpsertCounts(segment["rows"] - updated, updated)

    def _write(self, seg: str, rows: DataFrame, gone: DataFrame | None, now: Snapshot, merged: list[dict] | None = None) -> dict:
        """Writes all tables of a segment; with ``merged``, one that stands for those segments."""
        path = lambda table: f"{self.root}/{table}/seg={seg}"
        zstd = lambda df: df.write.option("compression", "zstd").option("parquet.writer.version", "v2")
        # A rebalance keeps a month together but splits a large one.
        zstd(rows.hint("rebalance", "month").sortWithinPartitions("month", F.desc("rowid"))).partitionBy("month").parquet(path("data"))
        if not self.files.exists(path("data")) or not self.files.folders(f"{path('data')}/month=*"):
            return {"rows": 0, "gone": 0}
        data = self.spark.read.schema(self.schema).parquet(path("data"))
        if merged is not None:
            ids = now._read("ids", _schema(IDS_SCHEMA), merged)
            ids = ids.groupBy("hash", "message_id").agg(F.max_by(F.struct("rowid", "month", "date_utc"), "seq").alias("x")).select("hash", "message_id", "x.*")
        else:
            ids = data.select(F.xxhash64("message_id").alias("hash"), "message_id", "rowid", "month", "date_utc")
        directory = zstd(ids.repartitionByRange("hash").sortWithinPartitions("hash"))
        directory = directory.option("parquet.bloom.filter.enabled#message_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true")

        def write_ids() -> None:
            ids_at_most = sum(f["n"] for f in facts.result())  # for the size of the filters
            directory.option("parquet.bloom.filter.expected.ndv#message_id", str(ids_at_most)).parquet(path("ids"))

        def write_gone() -> list:
            zstd(gone).parquet(path("gone"))
            return _few(self.spark.read.schema(GONE_SCHEMA).parquet(path("gone")))

        with ThreadPoolExecutor(3) as beside, batch_rows(self.spark, B.SLICE):  # jobs that do not need each other
            facts = beside.submit(lambda: data.groupBy("month").agg(F.count("*").alias("n"), F.max("rowid").alias("last")).collect())  # one row a month
            listed = beside.submit(write_ids)
            few = beside.submit(write_gone) if gone is not None else None
            zstd(B.blocks(data).hint("rebalance", "month", "gram").sortWithinPartitions("month", "gram", "field", "slice")).partitionBy("month").parquet(path("blocks"))
            blocks = self.spark.read.schema(_schema(B.SCHEMA)).parquet(path("blocks")) if self.files.folders(f"{path('blocks')}/month=*") else self.spark.createDataFrame([], B.SCHEMA)
            words, n_gone = B.dictionary(blocks) if merged is None else now._read("grams", _schema(B.DICTIONARY), merged).drop("seq"), 0
            if few is not None:
                few, every = few.result(), self.spark.read.schema(GONE_SCHEMA).parquet(path("gone"))
                n_gone = len(few) if len(few) <= NAMED else every.count()
                if merged is None and n_gone:  # what the rows that are replaced had
                    replaced = now.at(few) if len(few) <= NAMED else now.mails().join(every, ["month", "rowid"], "left_semi")
                    words = words.unionByName(B.dictionary(B.blocks(replaced.sortWithinPartitions("month", F.desc("rowid"))), -1))
            words = words.groupBy("gram", "field").agg(F.sum("messages").alias("messages"), F.sum("occurrences").alias("occurrences"))
            words = words.filter("messages <> 0 or occurrences <> 0")
            zstd(words.hint("rebalance", "gram").sortWithinPartitions("gram", "field")).parquet(path("grams"))
            words = self.spark.read.schema(B.DICTIONARY).parquet(path("grams"))
            length = words.filter(F.col("field") == B.ALL).agg(F.sum("occurrences")).first()[0] or 0
            facts, _ = facts.result(), listed.result()
        return {"id": seg, "rows": sum(f["n"] for f in facts), "gone": n_gone, "seq": max((s["seq"] for s in now.segments), default=0) + 1, "months": {f["month"]: [f["n"], f["last"]] for f in facts}, "length": length}

    def _publish(self, now: Snapshot, after: dict, seg: str) -> None:
        if not self.files.create(f"{self.pointers}/{now.version + 1:012d}.json", json.dumps(after, sort_keys=True)):
            self._drop(seg)
            raise RuntimeError("conflict: another writer has changed the store")

    def _drop(self, seg: str) -> None:
        for table in TABLES:
            self.files.delete(f"{self.root}/{table}/seg={seg}")

    def compact(self, everything: bool = False) -> bool:
        """Merges the newest segments if they are due, or all; whether it did.  Another writer's upsert meanwhile goes first."""
        now = self.snapshot()
        first, size = len(now.segments), 0
        for i in range(len(now.segments) - 1, -1, -1):
            if not everything and now.segments[i]["rows"] > FANOUT * max(size, SMALL):
                break
            first, size = i, size + now.segments[i]["rows"]
        chosen = now.segments[first:]
        if len(chosen) < (2 if everything else FANOUT):
            return False
        seg = f"{int(time.time() * 1000):015d}-{uuid.uuid4().hex[:8]}"
        older = now.segments[:first]
        gone = now._read("gone", _schema(GONE_SCHEMA), chosen).select("rowid", "month").distinct() if older and any(s["gone"] for s in chosen) else None
        try:
            segment = self._write(seg, now.all_rows(chosen).drop("seq"), gone, now, chosen)
            if not segment["rows"]:
                raise RuntimeError("conflict: nothing is left of these segments")
            made = {k: segment[k] for k in ("id", "rows", "gone", "months")} | {"seq": chosen[-1]["seq"]}
            self._publish(now, {"segments": [*older, made], "rows": now.rows, "length": now.length}, seg)
        except RuntimeError as e:
            if "conflict" not in str(e):
                raise
            self._drop(seg)
            return False
        return True

    def vacuum(self, older_than_s: float = 24 * 3600) -> int:
        """Deletes segments that are no longer valid and older than that, drafts as old, and pointers before the newest; returns the number of segments."""
        version = self.version()
        valid, limit, gone = {s["id"] for s in self.snapshot().segments}, (time.time() - older_than_s) * 1000, 0
        for path in self.files.folders(f"{self.root}/data/seg=*"):
            seg = path.rsplit("/", 1)[1].partition("=")[2]
            if seg not in valid and int(seg.partition("-")[0]) < limit:
                self._drop(seg)
                gone += 1
        for path in self.files.folders(f"{self.root}/drafts/*"):  # of writers that died
            if int(path.rsplit("/", 1)[1].partition("-")[0]) < limit:
                self.files.delete(path)
        for name in self.files.names(self.pointers):
            if re.fullmatch(r"\d+\.json", name) and int(name[:-5]) < version:
                self.files.delete(f"{self.pointers}/{name}")
        return gone

    def log_errors(self, errors: DataFrame) -> None:
        errors.write.mode("append").json(f"{self.root}/errors")

    def recent_errors(self, most: int = 500) -> DataFrame:
        path = f"{self.root}/errors"
        if not self.files.exists(path):
            return self.spark.createDataFrame([], ERROR_SCHEMA)
        return recent(self.spark.read.schema(ERROR_SCHEMA).option("mode", "DROPMALFORMED").json(path), most)

    def state(self) -> StateLog:
        return StateLog(self.spark, self.files, f"{self.root}/state")


def recent(errors: DataFrame, most: int = 500) -> DataFrame:
    return errors.orderBy(F.desc("ts"), "file_path", "error").limit(most)


class StateLog:
    """What became of each container, as records that are only ever appended.

    ``save`` writes what was set since the last as one numbered file, whatever the number of containers.  After
    ``FOLD`` files, Spark folds them and the last base into a new base, the last record of a path
    staying.  Readers take the newest whole base and the files after it; lines that cannot be read are
    left out.  Numbers are given out as those of pointers are, so two writers do not overwrite each other.
    """

    FOLD = 64

    def __init__(self, spark: SparkSession, files: Files, path: str):
        self.spark, self.files, self.path = spark, files, path
        self.unsaved: dict[str, dict] = {}

    def set(self, path: str, status: str, size: int | None = None, mtime: float | None = None, mails_written: int | None = None, error: str | None = None) -> None:
        if status not in STATES:
            raise ValueError(f"unknown status {status!r}")
        self.unsaved[path] = {"path": path, "size": size, "mtime": mtime, "status": status, "mails_written": mails_written, "error": error, "updated_at": int(time.time())}

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(m[1]) for n in self.files.names(self.path) if (m := re.fullmatch(rf"{kind}-(\d+)(?:\.json)?", n)))

    def _base(self) -> int:
        """The number of the newest base that is whole; 0 if there is none."""
        return max((n for n in self._numbers("base") if self.files.exists(f"{self.path}/base-{n:012d}/_SUCCESS")), default=0)

    def save(self) -> None:
        if not self.unsaved:
            return
        base = self._base()
        number = max([base, *self._numbers("log")]) + 1
        while True:
            lines = "".join(json.dumps({**r, "seq": number}, ensure_ascii=False) + "\n" for r in self.unsaved.values())
            if self.files.create(f"{self.path}/log-{number:012d}.json", lines):
                break
            number += 1
        self.unsaved.clear()
        if number - base >= self.FOLD:
            self._fold(number)

    def _fold(self, number: int) -> None:
        """Records up to a number become a base; what it stands for goes, but for the base before, which a reader may hold."""
        before, logs = self._base(), [n for n in self._numbers("log") if n <= number]
        self._records(number).write.mode("overwrite").json(f"{self.path}/base-{number:012d}")
        for n in self._numbers("base"):
            if n < before:
                self.files.delete(f"{self.path}/base-{n:012d}")
        for n in logs:
            if n <= before:
                self.files.delete(f"{self.path}/log-{n:012d}.json")

    def _records(self, upto: int | None = None) -> DataFrame:
        base = self._base()
        logs = [n for n in self._numbers("log") if n > base and (upto is None or n <= upto)]
        paths = [f"{self.path}/log-{n:012d}.json" for n in logs] + ([f"{self.path}/base-{base:012d}"] if base else [])
        if not paths:
            return self.spark.createDataFrame([], f"{STATE_SCHEMA}, seq long")
        read = self.spark.read.schema(f"{STATE_SCHEMA}, seq long").option("mode", "DROPMALFORMED").json(paths).filter("path is not null and status is not null")
        last = F.max_by(F.struct(*(c for c in read.columns if c != "path")), "seq").alias("x")
        return read.groupBy("path").agg(last).select("path", "x.*")

    def frame(self) -> DataFrame:
        """The last record of each container."""
        return self._records().drop("seq")


def pending(plan: DataFrame, state: DataFrame) -> DataFrame:
    """Containers of ``plan(path, size, mtime)`` that are new, changed, or not completed."""
    done = state.filter("status = 'COMPLETED'").select("path", F.col("size").alias("s"), F.col("mtime").alias("m"))
    same = (plan["path"] == done["path"]) & (plan["size"] == done["s"]) & (F.abs(plan["mtime"] - done["m"]) < 1.0)
    return plan.join(done, same, "left_anti")


def summary(state: DataFrame) -> DataFrame:
    """Containers and messages by status."""
    return state.groupBy("status").agg(F.count("*").alias("files"), F.sum(F.coalesce("mails_written", F.lit(0))).alias("mails"))

"""Ingest in groups of containers, once or as a stream.

A group is read side by side, upserted and committed, and then noted in the state log, so what is done
stays done whenever the run ends, and a group that is repeated changes nothing.  The stream follows the
listing of the folders with Spark's file source: its checkpoint keeps what was seen, in compacted form, and
``commit_containers`` is what a trigger admits.  Contents are read by the containers' own readers only.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from fnmatch import fnmatch
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.normalize import errors, normalize
from ..operators.store import MailStore, StateLog, pending
from ..sources.discovery import GUIDANCE, plan
from ..sources.mailbox import read_containers

#: Spark's own columns of files.
FILES = "path string, modificationTime timestamp, length long, content binary"
Event = Callable[[str, dict], None]


def write_batch(store: MailStore, raw: DataFrame, settings: Settings, on_event: Event = lambda kind, info: None) -> dict:
    """Upserts the good messages of ``raw``, which its caller keeps, and logs the others."""
    counts = store.upsert(normalize(raw, settings))
    bad = errors(raw)
    failed = bad.count()
    if failed:
        store.log_errors(bad)
        on_event("errors", {"count": failed})
    info = {"inserted": counts.inserted, "updated": counts.updated, "errors": failed}
    on_event("batch", info)
    return info


def start(spark: SparkSession, store: MailStore, paths: list[str], checkpoint: str, settings: Settings | None = None, recursive: bool = False, once: bool = True, on_event: Event = lambda kind, info: None, **options: str) -> StreamingQuery:
    """Follows ``paths`` for new containers; with ``once`` it takes what is there and ends, else it runs until ``stop()``.

    A trigger takes at most ``commit_containers`` of them a path.  Containers that change are taken again by ``index``.
    """
    settings = settings or Settings()
    listing = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", settings.commit_containers)
    listing = listing.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pPoOmM][sS][tTgG]")
    tops = [os.path.abspath(p) for p in paths]
    names = reduce(DataFrame.unionByName, (listing.load(p).select("path") for p in paths))  # no content is read

    def take(batch: DataFrame, _: int) -> None:
        found = sorted(re.sub("^file:/+", "/", r["path"]) for r in batch.collect())  # as many as a trigger admits
        if not recursive:
            found = [f for f in found if os.path.dirname(f) in tops or any(fnmatch(f, t) for t in tops)]
        index(spark, store, found, settings, on_event=on_event, **options)

    writer = names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def index(spark: SparkSession, store: MailStore, paths: list[str], settings: Settings | None = None, recursive: bool = False, on_event: Event = lambda kind, info: None, **options: str) -> dict:
    """Reads what is new or changed once, and logs what becomes of it; returns totals.

    What is to be done comes from a join of the containers with the state log, and to the driver group by group.
    """
    settings = settings or Settings()
    state, plans = store.state(), plan(spark, paths, recursive)
    if options.get("reader"):
        plans = plans.withColumn("reader", F.lit(options["reader"]))
    every, todo = plans.count(), pending(plans, state.frame()).orderBy("path").persist()
    try:
        totals = {"completed": 0, "failed": 0, "skipped": every - todo.count(), "written": 0, "errors": 0}
        if totals["skipped"]:
            on_event("skipped", {"count": totals["skipped"], "reason": "unchanged"})
        for group in batched(todo.toLocalIterator(), max(settings.commit_containers, 1)):
            _group(spark, store, state, group, settings, totals, on_event, options)
    finally:
        todo.unpersist()
    return totals


def _group(spark: SparkSession, store: MailStore, state: StateLog, group: tuple[Row, ...], settings: Settings, totals: dict, on_event: Event, options: dict) -> None:
    """Reads and commits some containers, and notes them before and after."""
    note = lambda p, status, **more: state.set(p["path"], status, p["size"], p["mtime"], **more)
    for p in group:
        on_event("resolved", {"path": p["path"], "reader": p["reader"]})
        if p["reader"] is None:
            note(p, "FAILED", error=GUIDANCE)
            totals["failed"] += 1
            on_event("failed", {"path": p["path"], "error": GUIDANCE})
        else:
            note(p, "WRITING")
    state.save()
    group = tuple(p for p in group if p["reader"])
    if not group:
        return
    raw = read_containers(spark, [p["path"] for p in group], False, **options).persist()
    try:
        info = write_batch(store, raw, settings, on_event)
        of = raw.groupBy("file_path").agg(F.count_if(F.col("error").isNull()).alias("good"), F.max("error").alias("error"))
        seen = {r["file_path"]: r for r in of.collect()}  # one row a container
    finally:
        raw.unpersist()
    for p in group:
        row = seen.get(p["path"])
        failed = row is not None and row["good"] == 0 and row["error"] is not None
        note(p, "FAILED" if failed else "COMPLETED", mails_written=row["good"] if row else 0, error=row["error"] if failed else None)
        totals["failed" if failed else "completed"] += 1
        on_event("failed" if failed else "done", {"path": p["path"]})
    state.save()
    totals["written"] += info["inserted"] + info["updated"]
    totals["errors"] += info["errors"]

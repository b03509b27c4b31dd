"""Command line: ``index``, ``search``, ``show``, ``attach``, ``export`` and ``folders`` over a mail store."""

from __future__ import annotations

import argparse
import json
import sys
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import load_settings
from .operators import export, search
from .operators.store import MailStore, pending
from .plans.query_language import compose
from .sources.discovery import plan
from .sources.readers import fetch_attachment
from .streaming import ingest


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillstack")
    top.add_argument("--config")
    top.add_argument("--store")
    top.add_argument("--plugins", default="", help="modules that register more readers, with commas between")
    commands = top.add_subparsers(dest="command", required=True)

    index = commands.add_parser("index")
    index.add_argument("paths", nargs="+")
    index.add_argument("--recursive", action="store_true")
    index.add_argument("--dry-run", action="store_true")
    index.add_argument("--reader")

    for name in ("search", "export"):
        c = commands.add_parser(name)
        c.add_argument("query", nargs="?", default="")
        for flag in ("from", "to", "subject", "after", "before", "folder"):
            c.add_argument(f"--{flag}", dest=f"{flag}_" if flag == "from" else flag)
        c.add_argument("--has-attachment", choices=["yes", "no"])
        c.add_argument("--whole-word", action="store_true")
        if name == "search":
            c.add_argument("--limit", type=int, default=20)
            c.add_argument("--sort", choices=["date", "relevance"], default="date")
            c.add_argument("--json", action="store_true")
            c.add_argument("--csv")
        else:
            c.add_argument("--all", action="store_true")
            c.add_argument("--format", choices=["csv", "eml"], default="csv")
            c.add_argument("--out", required=True)

    show = commands.add_parser("show")
    show.add_argument("message_id")
    show.add_argument("--highlight", metavar="QUERY", default="", help="mark what a query looks for")
    attach = commands.add_parser("attach")
    attach.add_argument("message_id")
    attach.add_argument("--index", type=int, default=0)
    attach.add_argument("--out", default=".")
    commands.add_parser("folders")
    return top


def _query(args: argparse.Namespace) -> str:
    return compose(args.query, from_=args.from_, to=args.to, subject=args.subject, after=args.after, before=args.before, folder=args.folder, has_attachment=args.has_attachment)


def _index(spark: SparkSession, store: MailStore, args: argparse.Namespace, settings) -> int:
    if args.dry_run:
        plans, todo = plan(spark, args.paths, args.recursive), F.lit("unchanged")
        due = pending(plans, store.state().frame()).select("path", F.lit("").alias("due"))
        for p in plans.join(due, "path", "left").withColumn("skip", F.coalesce("due", todo)).orderBy("path").toLocalIterator():
            print(p["path"], p["size"], p["reader"] or "-", p["skip"])
        return 0
    more = {"reader": args.reader} if args.reader else {}
    totals = ingest.index(spark, store, args.paths, settings, args.recursive, plugins=args.plugins, **more)
    print(json.dumps(totals))
    return int(totals["failed"] > 0 and totals["completed"] == 0)


def _search(store: MailStore, args: argparse.Namespace) -> int:
    now = store.snapshot()
    result = search.search(now.mails(), _query(args), args.limit, args.sort, args.whole_word, index=now)
    if args.json:
        print(export.result_json(result))
    elif args.csv:
        export.write_csv_file(export.hit_rows(result.hits), args.csv, export.HIT_CSV_COLUMNS)
    else:
        export.hit_rows(result.hits).show(args.limit, truncate=40)
        for p in result.diagnosis:
            print(f"{'!' if p.culprit else ' '} {p.label}: {p.count}")
    for w in result.warnings:
        print(w, file=sys.stderr)
    return 0


def _export(store: MailStore, args: argparse.Namespace) -> int:
    raw = _query(args)
    if not raw and not args.all:
        print("give a query, or --all", file=sys.stderr)
        return 2
    now = store.snapshot()
    found = search.matches(now.mails(), search.parse(raw), args.whole_word, index=now)
    if args.format == "eml":
        n = export.write_eml(found, args.out)
    else:
        n = export.write_csv_file(found.orderBy(*search.newest_first()), args.out)
    print(n)
    return 0


def _attach(store: MailStore, args: argparse.Namespace) -> int:
    row = store.snapshot().get(args.message_id).select("file_path", "locator_json").first()
    if row is None:
        print("no such message", file=sys.stderr)
        return 1
    print(export.save_attachment(*fetch_attachment(row["file_path"], row["locator_json"], args.index), args.out))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments().parse_args(argv)
    for name in filter(None, args.plugins.split(",")):
        import_module(name)
    settings = load_settings(args.config)
    spark = spark or SparkSession.builder.appName("quillstack").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = MailStore(spark, args.store or settings.db_path, settings)
    if args.command == "index":
        return _index(spark, store, args, settings)
    if args.command == "search":
        return _search(store, args)
    if args.command == "export":
        return _export(store, args)
    if args.command == "attach":
        return _attach(store, args)
    if args.command == "folders":
        for r in search.list_folders(store.mails()).toLocalIterator():
            print(r[0])
        return 0
    found, marks = store.snapshot().get(args.message_id), search.parse(args.highlight)
    for column in ("subject", "body"):
        found = search.highlighted(found, marks, column, column)
    row = found.select(*export.EXPORT_COLUMNS, F.col("decode_status")).first()
    if row is None:
        print("no such message", file=sys.stderr)
        return 1
    for name, value in row.asDict().items():
        print(f"{name}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

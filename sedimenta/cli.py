"""Command line: ``python -m sedimenta.cli --warehouse FOLDER load-reports|load-studies|cases|gates|refresh|search|keys ...``."""

from __future__ import annotations

import argparse
import datetime as dt
import hashlib
import re
import secrets
import sys

from pyspark.sql import functions as F

from sedimenta.functions import text
from sedimenta.operators import cases, gates, report, search, status
from sedimenta.operators.load import Warehouse
from sedimenta.session import build_session, ship
from sedimenta.sources.records import NORMALIZERS
from sedimenta.sources.tables import GRAINS, case_report_specs, study_specs
from sedimenta.streaming.refresh import DocumentStore, choose, refresh_all


def quarter(text: str) -> str:
    """A quarter like 2025Q1."""
    if not re.fullmatch(r"(19|20)\d\d[Qq][1-4]", text):
        raise argparse.ArgumentTypeError(f"{text!r} is no quarter like 2025Q1")
    return text.upper()


def snapshot(text: str) -> str:
    """A snapshot day, the first of a month."""
    try:
        day = dt.date.fromisoformat(text)
    except ValueError as e:
        raise argparse.ArgumentTypeError(f"{text!r} is no day like 2025-01-01") from e
    if day.day != 1:
        raise argparse.ArgumentTypeError("a snapshot is the first day of a month")
    return text


def previous_month(today: dt.date) -> str:
    return str((today.replace(day=1) - dt.timedelta(days=1)).replace(day=1))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedimenta", description=__doc__)
    top.add_argument("--warehouse", required=True, help="folder of the tables")
    sub = top.add_subparsers(dest="command", required=True)
    reports = sub.add_parser("load-reports", help="load archives of case reports")
    reports.add_argument("archives", nargs="+", help="archive=quarter")
    reports.add_argument("--limit", type=int)
    studies = sub.add_parser("load-studies", help="load an archive of studies")
    studies.add_argument("archive")
    studies.add_argument("--snapshot", type=snapshot, default=previous_month(dt.date.today()))
    studies.add_argument("--limit", type=int)
    sub.add_parser("cases", help="rebuild the current cases")
    check = sub.add_parser("gates", help="run the gates; exit code 1 if one fails")
    check.add_argument("--report", help="Markdown file to write")
    fresh = sub.add_parser("refresh", help="take in landing folders of documents")
    fresh.add_argument("landings", nargs="+", help="source=folder")
    fresh.add_argument("--full", action="store_true", help="read the folders again from the start")
    find = sub.add_parser("search", help="search the documents by text")
    find.add_argument("query")
    find.add_argument("--source")
    find.add_argument("-k", type=int, default=10)
    keys = sub.add_parser("keys", help="issue, revoke and list access keys")
    keys.add_argument("action", choices=("issue", "revoke", "list"))
    keys.add_argument("--plan", default="free")
    keys.add_argument("--key", help="the key, or the first letters of its digest, to revoke")
    return top


KEY_EVENTS = "key_hash string, plan string, active boolean, created_at timestamp"


def manage_keys(spark, folder: str, action: str, plan: str, key: str | None) -> int:
    """Issue a key (printed once, stored as its digest), revoke those that match (how many is printed), or list all."""
    store = Warehouse(spark, folder)
    now = dt.datetime.now(dt.timezone.utc)
    add = lambda rows: spark.createDataFrame(rows, KEY_EVENTS).coalesce(1).write.mode("append").parquet(f"{folder}/key_event")
    digest = lambda k: hashlib.sha256(k.strip().encode()).hexdigest()
    if action == "issue":
        made = secrets.token_urlsafe(32)
        add([(digest(made), plan, True, now)])
        print(made)
        return 0
    events = store.read("key_event") if store.exists("key_event") else spark.createDataFrame([], KEY_EVENTS)
    if action == "list":
        for r in status.list_keys(events, F.lit(now)).collect():
            print(f"{r['key_id']} {r['plan']} {'active' if r['active'] else 'revoked'} {r['since']}")
        return 0
    if not key:
        print("name a key to revoke", file=sys.stderr)
        return 2
    match = (F.col("key_hash") == digest(key)) | ((F.length(F.lit(key)) >= 6) & F.col("key_hash").startswith(key))
    gone = status.key_state(events).where(F.col("active") & match).collect()
    if gone:
        add([(r["key_hash"], r["plan"], False, now) for r in gone])
    print(f"revoked {len(gone)}")
    return 0 if gone else 1


def rebuild_cases(store: Warehouse) -> None:
    tables = store.tables(["faers_demo", "faers_deleted_case"])
    if len(tables) == 2:
        cases.current_cases(tables["faers_demo"], tables["faers_deleted_case"]).write.mode("overwrite").parquet(f"{store.path}/faers_case_current")


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    ship(spark)
    store = Warehouse(spark, args.warehouse)
    if args.command == "load-reports":
        for item in args.archives:
            archive, _, label = item.rpartition("=")
            label = quarter(label)
            for name, done in store.load_archive(archive, case_report_specs(label), "faers", label, args.limit).items():
                print(f"{label} {name}: {done.read} read, {done.loaded} loaded, {done.rejected} rejected")
        rebuild_cases(store)
    elif args.command == "load-studies":
        for name, done in store.load_archive(args.archive, study_specs(), "aact", args.snapshot, args.limit).items():
            print(f"{args.snapshot} {name}: {done.read} read, {done.loaded} loaded, {done.rejected} rejected")
    elif args.command == "cases":
        rebuild_cases(store)
    elif args.command == "refresh":
        landings = dict(x.split("=", 1) for x in args.landings)
        documents = DocumentStore(spark, f"{store.path}/documents")
        told = refresh_all(spark, documents, {s: landings[s] for s in choose(list(NORMALIZERS), list(landings))}, f"{store.path}/_stream", dt.datetime.now(dt.timezone.utc), args.full)
        for source, outcome in told.items():
            print(f"{source}: {outcome}")
        return int(any(x.startswith("error") for x in told.values()))
    elif args.command == "search":
        documents = DocumentStore(spark, f"{store.path}/documents")
        held = documents.read(args.source) if args.source else documents.all()
        if held is None:
            print("no documents")
            return 1
        terms = held.withColumn("terms", text.stemmed_terms(F.concat_ws(" ", "title", "embed_text")))
        for r in search.search_text(terms, args.query, args.k).collect():
            print(f"{r['source_id']} {r['doc_id']} {r['rank']:.3f} {r['title']}")
    elif args.command == "keys":
        return manage_keys(spark, store.path, args.action, args.plan, args.key)
    else:
        tables = store.tables(list(GRAINS))
        results = gates.run_gates(tables, store.runs(), store.read("load_reject"))
        for g in results:
            print(f"{'pass' if g.passed else 'FAIL'} {g.name}: {g.rows_checked} rows, {len(g.failures)} failures")
        if args.report:
            precision = [r.asDict() for r in gates.precision_report(tables).collect()] if "faers_demo" in tables else []
            report.write(args.report, report.render(results, {"date precision": precision}))
        return int(not all(g.passed for g in results))
    return 0


if __name__ == "__main__":
    sys.exit(main())

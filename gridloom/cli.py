"""Command line: info, ingest, migrate, consolidate, sample, recovery."""

from __future__ import annotations

import argparse
import json

from gridloom.ingest import ingest
from gridloom.maintenance import migrate
from gridloom.operators.compaction import write_consolidated
from gridloom.session import local_session
from gridloom.sources.sample import sample_data_path
from gridloom.warehouse import Warehouse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="command", required=True)
    info = sub.add_parser("info", help="what a warehouse holds")
    info.add_argument("warehouse")
    info.add_argument("--snapshots", action="store_true", help="also the last ten snapshots")
    take = sub.add_parser("ingest", help="register rasters as scenes")
    take.add_argument("source")
    take.add_argument("warehouse")
    take.add_argument("--product")
    move = sub.add_parser("migrate", help="move chunk files into a warehouse")
    move.add_argument("source")
    move.add_argument("warehouse")
    move.add_argument("--dry-run", action="store_true")
    move.add_argument("--backup")
    move.add_argument("--batches", type=int, default=1, help="commits to divide the work into")
    few = sub.add_parser("consolidate", help="merge the records of many small chunk files into few files")
    few.add_argument("records", help="Parquet table of records: row_id, chunk_path, time, pixels, mask")
    few.add_argument("target", help="folder of the new files, their list and metadata")
    few.add_argument("--catalogue", help="Parquet table of the old catalogue")
    few.add_argument("--bytes", type=int, default=128 << 20, help="size at which a file is closed")
    sub.add_parser("sample", help="make sample rasters and tell where they are")
    rec = sub.add_parser("recovery", help="look for what broken commits left")
    rec.add_argument("action", choices=["diagnose", "repair", "verify"])
    rec.add_argument("warehouse")
    rec.add_argument("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session()
    if args.command == "ingest":
        result = ingest(spark, args.source, args.warehouse, **({"product_id": args.product} if args.product else {}))
        print(json.dumps(result.__dict__, default=str))
        return int(bool(result.errors))
    if args.command == "migrate":
        print(json.dumps(migrate(spark, args.source, args.warehouse, args.dry_run, args.backup, batches=args.batches).__dict__))
        return 0
    if args.command == "consolidate":
        old = spark.read.parquet(args.catalogue) if args.catalogue else None
        made = write_consolidated(spark.read.parquet(args.records), args.target, args.bytes, catalogue=old)
        print(json.dumps({"chunks": made.count(), "files": made.select("out_file").distinct().count()}))
        return 0
    if args.command == "sample":
        print(sample_data_path())
        return 0
    if args.command == "info":
        store = Warehouse(spark, args.warehouse)
        print(json.dumps(store.summary(), default=str))
        if args.snapshots:
            store.history().limit(10).show(truncate=False)
        return 0
    store = Warehouse(spark, args.warehouse)
    found = store.diagnose()
    if args.action == "repair":
        print(json.dumps({"deleted": store.repair(args.dry_run)}))
        return 0
    print(json.dumps(found))
    return int(bool(found["missing"])) if args.action == "verify" else 0


if __name__ == "__main__":
    raise SystemExit(main())

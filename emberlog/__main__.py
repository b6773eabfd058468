"""Queries a store from the command line:  python -m emberlog STORE query '{service="api"} |= "x"' --since 1h"""

from __future__ import annotations

import argparse
import re
import sys
from datetime import UTC, datetime, timedelta

from pyspark.sql import SparkSession

from emberlog.engine import Engine
from emberlog.operators import report, storage
from emberlog.plans.ast import QueryError
from emberlog.session import ship
from emberlog.streaming import ingest

UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def moment(text: str, now: datetime) -> datetime:
    """An ISO time, or so long ago: 90s, 15m, 1h, 7d."""
    if m := re.fullmatch(r"(\d+)([smhd])", text):
        return now - timedelta(**{UNITS[m[2]]: int(m[1])})
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=UTC)


def parsed(args: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="emberlog", description=__doc__)
    top.add_argument("store")
    does = top.add_subparsers(dest="does", required=True)
    query = does.add_parser("query")
    query.add_argument("text")
    query.add_argument("--since", default="1h")
    query.add_argument("--until", default="0s")
    query.add_argument("--limit", type=int)
    query.add_argument("--forward", action="store_true")
    query.add_argument("--json", action="store_true")
    does.add_parser("labels").add_argument("name", nargs="?")
    does.add_parser("stats")
    does.add_parser("compact")
    does.add_parser("retain").add_argument("--days", type=int, default=storage.RETENTION_DAYS)
    return top.parse_args(args)


def run(spark: SparkSession, args: argparse.Namespace, now: datetime) -> list[str]:
    """The lines to print."""
    store = ingest.Store(args.store)
    if args.does == "compact":
        return [f"{table}: {', '.join(days) or 'nothing to do'}" for table, days in ingest.compact(spark, store, now).items()]
    if args.does == "retain":
        return storage.drop_old_partitions(spark, store.logs, now, args.days)
    if args.does == "stats":
        return [f"{k}: {v:g}" for k, v in storage.statistics(spark, store.logs).items()]
    engine = Engine(ingest.catalog(spark, store))
    if args.does == "labels":
        return engine.label_values(args.name) if args.name else engine.labels()
    found = engine.query(args.text, moment(args.since, now), moment(args.until, now), args.limit, "forward" if args.forward else "backward")
    rows = found.records if found.records is not None else found.points
    if args.json:
        return [report.json_line(r) for r in rows]
    out = [report.text_row(r) if found.records is not None else " ".join(map(str, (r["bucket"], r["value"], r["by"] or ""))) for r in rows]
    return [*out, "... more records match"] if found.truncated else out


def main() -> int:
    args = parsed(sys.argv[1:])
    spark = SparkSession.builder.appName("emberlog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    try:
        print(*run(spark, args, datetime.now(UTC)), sep="\n")
    except QueryError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())

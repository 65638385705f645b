"""Command line: load one date into silver, pass the gate, refresh snapshots, update gold by deltas.

    spark-submit -m polderlake.plans.daily --bronze ... --silver ... --gold ... [--date ...]
"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone

from pyspark.sql import functions as F

from polderlake.operators.quality import enforce_gate, run_summary
from polderlake.plans.gold import build_gold
from polderlake.plans.silver import FEED_READERS, build_date, refresh_all
from polderlake.session import build_session, clear_scratch
from polderlake.sources.compaction import compact, read_packed
from polderlake.sources.tables import RUN_SCHEMA


def main(argv: list[str] | None = None) -> dict[str, int]:
    now = datetime.now(timezone.utc).replace(microsecond=0)
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--bronze", required=True, help="root of the landed files")
    parser.add_argument("--silver", required=True, help="root of the silver tables")
    parser.add_argument("--gold", required=True, help="root of the gold tables")
    parser.add_argument("--runs", help="path of the run records")
    parser.add_argument("--date", default=now.strftime("%Y-%m-%d"), help="ingestion date")
    parser.add_argument("--layout", choices=["envelope", "pages"], default="envelope")
    parser.add_argument("--skip", nargs="*", default=[], choices=list(FEED_READERS),
                        help="feeds to leave out")
    args = parser.parse_args(argv)
    spark = build_session("polderlake-daily")
    try:
        counts = build_date(spark, args.bronze, args.silver, args.date, now, args.runs, args.layout,
                            {name: None for name in args.skip})
        if args.runs:
            runs = read_packed(spark, args.runs, RUN_SCHEMA)
            enforce_gate(run_summary(runs.where(F.col("ingestion_date") == args.date)))
            compact(spark, args.runs, RUN_SCHEMA)  # each run leaves some files of a few rows
        as_of, previous = refresh_all(spark, args.silver, args.date)
        return {**counts, **build_gold(spark, args.silver, args.gold, now, as_of, previous)}
    finally:
        clear_scratch(spark)


if __name__ == "__main__":
    for table, rows in main().items():
        print(f"{table}: {rows}")

"""Write the reports and series of a period: ``python -m fundperf --tables DIR --out DIR``."""

from __future__ import annotations

import argparse

from fundperf.constants import REPORT_FUNDS
from fundperf.plans.reports import write_annual_report
from fundperf.session import session
from fundperf.sources import jdbc_tables, parquet_tables


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fundperf", description=__doc__)
    parser.add_argument("--tables", help="folder with the domain tables as Parquet; JDBC settings otherwise")
    parser.add_argument("--out", required=True, help="new folder for the results")
    parser.add_argument("--start", default="2024-05-01")
    parser.add_argument("--end", default="2025-05-01")
    parser.add_argument("--jdbc-partitions", type=int, default=16)
    parser.add_argument("--jdbc-balanced", action="store_true", help="ranges of about as many rows each, by a count by day")
    parser.add_argument("--history-start", help="first day of the tables; asked of the database if not given")
    parser.add_argument("--history-end", help="last day of the tables")
    parser.add_argument("--funds", nargs="+", default=list(REPORT_FUNDS), help="funds with a line of their own")
    parser.add_argument("--rf-fill", choices=["reference", "previous"], default="reference")
    parser.add_argument("--run", help="subfolder of this run")
    args = parser.parse_args(argv)
    if bool(args.history_start) != bool(args.history_end):
        parser.error("--history-start and --history-end belong together")
    spark = session("fundperf")
    if args.tables:
        tables = parquet_tables(spark, args.tables)
    else:
        history = (args.history_start, args.history_end) if args.history_start else None
        tables = jdbc_tables(spark, partitions=args.jdbc_partitions, history=history, balanced=args.jdbc_balanced)
    write_annual_report(tables, args.start, args.end, args.out, args.funds, args.rf_fill, args.run)


if __name__ == "__main__":
    main()

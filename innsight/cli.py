"""Command line: what the reference's pages offer, as Spark jobs.

    python -m innsight.cli dashboard --tables ROOT --out DIR
    python -m innsight.cli search --tables ROOT --kind guest --q NAME [--out DIR | --show 20]
    python -m innsight.cli check --tables ROOT --out DIR
    python -m innsight.cli ingest --src DIR --table charge --tables ROOT [--format csv]

``--tables ROOT`` reads the declared tables (one Parquet folder per table);
``--driver SF_DIR`` maps the TPC-H-shaped driver tables instead.  Results are
written as Parquet (``--out``); ``--show N`` prints the first N rows of a
search, like the search page, with report formatting.
"""

from __future__ import annotations

import argparse
import sys

from innsight.session import build_session


def _tables(spark, args):
    if args.driver:
        from innsight.sources.derived import hotel_tables

        return hotel_tables(spark, args.driver)
    from innsight.sources.tables import load

    return load(spark, args.tables)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="innsight")
    ap.add_argument("--master", default=None, help="Spark master (default: the launcher's)")
    ap.add_argument("--profile", default="local", choices=["local", "cluster"])
    sub = ap.add_subparsers(dest="cmd", required=True)

    def source(p):
        g = p.add_mutually_exclusive_group(required=True)
        g.add_argument("--tables", help="root folder of the declared Parquet tables")
        g.add_argument("--driver", help="folder of the driver's TPC-H-shaped tables")

    p = sub.add_parser("dashboard", help="refresh the eight dashboard results")
    source(p)
    p.add_argument("--out", required=True)
    p.add_argument("--start", default="2025-01-01")
    p.add_argument("--end", default="2025-04-01")

    p = sub.add_parser("search", help="guest, hotel or staff search")
    source(p)
    p.add_argument("--kind", default="guest")
    p.add_argument("--q", default="")
    p.add_argument("--out")
    p.add_argument("--show", type=int, default=0)

    p = sub.add_parser("check", help="NOT NULL, key and reference checks")
    source(p)
    p.add_argument("--out", required=True)

    p = sub.add_parser("ingest", help="load new raw files of one table")
    p.add_argument("--src", required=True)
    p.add_argument("--table", required=True)
    p.add_argument("--tables", required=True, help="root folder of the declared Parquet tables")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"])
    p.add_argument("--columns", default=None, help="comma-separated CSV columns in file order")

    args = ap.parse_args(argv)
    spark = build_session(args.master, profile=args.profile)

    if args.cmd == "dashboard":
        from innsight.plans.dashboard import refresh_dashboard

        for key, path in refresh_dashboard(spark, _tables(spark, args), args.out,
                                           window=(args.start, args.end)).items():
            print(f"{key}\t{path}")
    elif args.cmd == "search":
        from innsight.operators.search import search
        from innsight.plans.reports import report

        df = search(_tables(spark, args), args.kind, args.q)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        if args.show:
            name = {"guest": "search_guest", "hotel": "search_hotel", "staff": "search_staff"}.get(args.kind)
            (report(df, name) if name else df).show(args.show, truncate=False)
    elif args.cmd == "check":
        from innsight.operators import quality

        t = _tables(spark, args)
        for name, df in (("nulls", quality.null_report(t)), ("keys", quality.key_report(t)),
                         ("orphans", quality.orphan_report(t))):
            df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
            print(f"{name}\t{args.out.rstrip('/')}/{name}")
    elif args.cmd == "ingest":
        from innsight.streaming.ingest import ingest_files

        cols = args.columns.split(",") if args.columns else None
        ingest_files(spark, args.src, args.table, args.tables, fmt=args.format, columns=cols).awaitTermination()
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: run one menu query over a folder of raw input files and print it.

    python -m cumulus menu 4 --data path/to/raw_data [--releases] [--rows 20] [--out results/q4 [--single-file]]
    python -m cumulus list
"""

from __future__ import annotations

import argparse


def main(argv=None) -> None:
    from cumulus.plans.menu import MENU

    ap = argparse.ArgumentParser(prog="cumulus")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    run = sub.add_parser("menu")
    run.add_argument("number", type=int, choices=sorted(MENU))
    run.add_argument("--data", required=True, help="folder with the seven raw input files")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--out", help="write the result as CSV (with header) to this path instead of printing")
    run.add_argument("--single-file", action="store_true", help="with --out: one file instead of one per partition")
    run.add_argument("--releases", action="store_true", help="series inputs may be folders of releases with other day columns")
    args = ap.parse_args(argv)
    if args.cmd == "list":
        for k, v in MENU.items():
            print(f"{k}  {v}")
        return

    from pyspark.sql import SparkSession

    from cumulus.plans.menu import menu_query, series_start
    from cumulus.session import ensure_checkpoint_dir
    from cumulus.sinks.csv import preview, write_csv
    from cumulus.sources.catalog import load_all

    spark = SparkSession.builder.appName("cumulus").getOrCreate()
    ensure_checkpoint_dir(spark)
    df = menu_query(args.number, load_all(spark, args.data, releases=args.releases),
                    series_start(spark, args.data, releases=args.releases))
    if args.out:
        write_csv(df, args.out, include_header=True, single_file=args.single_file)
    else:
        preview(df, args.rows, truncate=False)


if __name__ == "__main__":
    main()

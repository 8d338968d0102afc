"""Run the layer jobs: ``spark-submit -m viewmart`` or ``python -m viewmart``.

    python -m viewmart --base /lake --customers c.csv --tickets t.csv --viewing-logs l.csv
"""

import argparse
from datetime import date

from pyspark.sql import SparkSession

from viewmart.fixed_values import AS_OF
from viewmart.plans import medallion
from viewmart.session import ADAPTIVE_SETTINGS


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--base", required=True, help="folder of the layer tables")
    parser.add_argument("--customers", help="CSV file or folder")
    parser.add_argument("--tickets", help="CSV file or folder")
    parser.add_argument("--viewing-logs", help="CSV file or folder")
    parser.add_argument("--as-of", type=date.fromisoformat, default=AS_OF, help="reporting date")
    parser.add_argument("--layers", nargs="+", choices=["silver", "gold"], default=["silver", "gold"])
    parser.add_argument("--gold-tables", nargs="+", choices=medallion.GOLD_TABLES, default=None)
    parser.add_argument("--multi-line", action="store_true", help="cells of the CSV files may hold line breaks")
    parser.add_argument("--find-formats", action="store_true", help="find out how dates and numbers are written")
    parser.add_argument("--clustered", action="store_true", help="store gold in the order of its filters")
    parser.add_argument("--max-unreadable", type=int, default=None, help="fail if more cells cannot be read")
    parser.add_argument("--csv-copy", action="store_true", help="also export each table as CSV")
    args = parser.parse_args()

    builder = SparkSession.builder.appName("viewmart")
    for key, value in ADAPTIVE_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    paths = {"customers": args.customers, "tickets": args.tickets, "viewing_logs": args.viewing_logs}
    given = {table: path for table, path in paths.items() if path}
    if "silver" in args.layers:
        if not given:
            parser.error("the silver layer needs at least one CSV source")
        bronze, unread = medallion.take_in(spark, given, args.base, args.multi_line, args.find_formats)
        medallion.run_unreadable(bronze, args.base, args.max_unreadable, unread).show(1000, truncate=False)
        medallion.run_silver(bronze, args.base, args.as_of, args.csv_copy)
    if "gold" in args.layers:
        medallion.run_gold(spark, args.base, args.as_of, args.csv_copy, args.gold_tables, args.clustered)
    spark.stop()


if __name__ == "__main__":
    main()

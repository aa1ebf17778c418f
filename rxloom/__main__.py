"""python -m rxloom QUERY FOLDER OUT: runs a query over a folder of tables and writes its rows as Parquet; without arguments the names of all. Queries on text have an entry of their own."""

from __future__ import annotations

import sys


def known() -> dict:
    from rxloom.plans import core_problems, grading, market, reports

    return core_problems.QUERIES | market.QUERIES | grading.QUERIES | reports.QUERIES


def main(args: list[str]) -> int:
    if len(args) != 3 or args[0] not in known():
        print(__doc__, *sorted(known()), sep="\n")
        return 1 if args else 0
    from rxloom.session import local_session

    spark = local_session()
    known()[args[0]](spark, args[1]).write.mode("overwrite").parquet(args[2])
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

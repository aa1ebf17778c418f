"""python -m rxloom.llm QUERY FOLDER OUT: runs a query on text over a folder of tables; without arguments the names of all."""

from __future__ import annotations

import sys

from rxloom.llm.queries import QUERIES
from rxloom.session import local_session

if len(sys.argv) != 4 or sys.argv[1] not in QUERIES:
    print(__doc__, *sorted(QUERIES), sep="\n")
    sys.exit(len(sys.argv) > 1)
spark = local_session()
QUERIES[sys.argv[1]](spark, sys.argv[2]).write.mode("overwrite").parquet(sys.argv[3])
spark.stop()

"""One row per value of fields that hold several, by the grammar of rxloom.functions.peg.

Fields without any delimiter or heading never leave the JVM. The rest is parsed in Arrow batches where it lies, without a shuffle;
a bounded cache spares the parse of fields seen before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions.arrow import Memo, arrow_schema
from rxloom.functions.peg import LISTED, SUBSTANCES, Grammar, parse

VALUES = "source_table string, row_id long, position_no int, item_value string, flag string"
GRAMMARS = {"substances": SUBSTANCES, "listed": LISTED}
#: Without one of these no grammar can split a field; a colon ends a part heading.
MAY_SPLIT = r"(?i)[:;,/+|&!\t\n•]|\s(and|with|et)\s"


def split_values(fields: list[tuple[str, DataFrame, str, str, str]], several_only: bool = True) -> DataFrame:
    """(source_table, row_id, position_no, item_value, flag) of fields given as (name, table, id, column, grammar).

    item_value is in upper case. Null, blank and sentinel fields give no rows; neither do single values unless
    several_only is off. flag: empty, or what was malformed (open_quote, open_bracket, text_after_quote). Repeated rows
    each give their values. An empty table gives no rows.
    """
    spark = fields[0][1].sparkSession
    target = arrow_schema(spark, VALUES)
    one = [
        t.select(F.lit(name).alias("source_table"), F.col(key).cast("long").alias("row_id"), F.lit(grammar).alias("grammar"), F.col(c).alias("text")).where(
            F.col("text").rlike(MAY_SPLIT) if several_only else F.col("text").isNotNull()
        )
        for name, t, key, c, grammar in fields
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(lambda k: parse(k[1], GRAMMARS[k[0]]), 50_000)
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("source_table", "row_id", "grammar", "text")]
            out: list[list] = [[], [], [], [], []]
            for name, key, g, text in zip(*cols):
                got = memo[(g, text)]
                if len(got) < (2 if several_only else 1):
                    continue
                for pos, value, flag in got:
                    for o, x in zip(out, (name, key, pos, value.upper(), flag)):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(o, t.type) for o, t in zip(out, target)], schema=target)

    return reduce(DataFrame.unionByName, one).mapInArrow(run, VALUES)


__all__ = ["Grammar", "split_values"]

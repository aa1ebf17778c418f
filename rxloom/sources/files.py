"""Readers of the delivered formats, and sinks. All give DataFrames with fixed schemas; nothing is inferred."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions.text import amount

#: Places of the used fields in the header-less extract files.
EXTRACT = {
    "drug": {0: "code", 3: "din", 4: "brand"}, "ingred": {0: "code", 2: "name", 4: "strength", 5: "unit"}, "form": {0: "code", 2: "form"}, "route": {0: "code", 2: "route"},
    "status": {0: "code", 1: "current", 2: "status", 3: "since"}, "comp": {0: "code", 3: "company"},
}


def extract_file(spark: SparkSession, path: str, kind: str, width: int = 14) -> DataFrame:
    """Used columns of one quoted, header-less latin-1 file by place; a short line leaves the rest null."""
    schema = ", ".join(f"_{i} string" for i in range(width))
    raw = spark.read.csv(path, schema=schema, encoding="ISO-8859-1", quote='"', escape='"')
    return raw.select(*[F.nullif(F.trim(f"_{i}"), F.lit("")).alias(n) for i, n in EXTRACT[kind].items()])


def extract_records(spark: SparkSession, folder: str) -> DataFrame:
    """One record per drug with code and DIN: children aggregated on the code, then left joins.

    Ingredients go by upper-case name; the status is what is flagged current, else all; the company the first by name.
    """
    f = {k: extract_file(spark, f"{folder}/{k}.txt", k) for k in EXTRACT}
    name = F.struct(F.upper("name").alias("k"), F.col("name"), F.concat_ws(" ", "strength", "unit").alias("s"))
    ing = f["ingred"].where("name IS NOT NULL").groupBy("code").agg(F.array_sort(F.collect_list(name)).alias("i"))
    ing = ing.select("code", F.array_join(F.transform("i", lambda x: x["name"]), "; ").alias("ingredient"), F.array_join(F.transform("i", lambda x: x["s"]), "; ").alias("strength"))
    listed = lambda d, c: d.groupBy("code").agg(F.array_join(F.array_sort(F.collect_set(c)), "; ").alias(c))
    now = F.collect_set(F.when(F.upper("current").startswith("Y"), F.col("status")))
    status = f["status"].groupBy("code").agg(F.array_join(F.array_sort(F.when(F.size(now) > 0, now).otherwise(F.collect_set("status"))), "; ").alias("status"))
    company = f["comp"].groupBy("code").agg(F.min("company").alias("company"))
    out = f["drug"].where("code IS NOT NULL AND din IS NOT NULL")
    for child in (ing, listed(f["form"], "form"), listed(f["route"], "route"), status, company):
        out = out.join(child, "code", "left")
    return out


def canary(records: DataFrame, din: str, brand: str, form: str) -> list[str]:
    """What is wrong with a known record: a sign that the places of the fields have moved."""
    r = records.where(F.col("din") == din).select("brand", "form", "company").first()
    if r is None:
        return [f"{din} is missing"]
    return [n for n, ok in (("brand", brand in (r.brand or "").upper()), ("form", form in (r.form or "").upper()), ("company", bool(r.company))) if not ok]


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON files that hold a list of objects or a single object."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


METRIC = re.compile(r"^(dollars|units|ext units)\s+mat\s+(?:(\d{4})/(\d{2})|(\d{2})/(\d{4}))$", re.I)


def metric_period(header: str) -> tuple[str, tuple[int, int]] | None:
    """(metric, (year, month)) of a header in either order."""
    m = METRIC.match(header.strip())
    if not m:
        return None
    return m[1].lower().replace(" ", "_"), ((int(m[2]), int(m[3])) if m[2] else (int(m[5]), int(m[4])))


def sales_extract(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, tuple[str, tuple[int, int]]]]:
    """The extract with text ids and whole-number metrics, and the metric and period of each metric column.

    Every field is read as text; an entry of a metric that is no number raises with up to ten of them.
    """
    raw = spark.read.option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)
    raw = raw.toDF(*[c.replace("﻿", "").strip() for c in raw.columns])
    metrics = {c: p for c in raw.columns if (p := metric_period(c))}
    bad = raw.select(F.explode(F.array(*[F.when(amount(F.col(f"`{c}`")).isNull(), F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in metrics])).alias("bad")).where("bad IS NOT NULL").limit(10).collect() if metrics else []
    if bad:
        raise ValueError("not numbers: " + "; ".join(r.bad for r in bad))
    return raw.select(*[F.floor(amount(F.col(f"`{c}`"))).cast("long").alias(c) if c in metrics else F.col(f"`{c}`") for c in raw.columns]), metrics


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, list[str]]] = []
        self.table, self.cell = -1, None
        self.row: list[str] = []
        self.header = True

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.table += 1
        elif tag == "tr":
            self.row = []
        elif tag == "td" or tag == "th" and self.header:
            self.cell = []

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(" ".join(data.split()))

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(", ".join(self.cell))
            self.cell = None
        elif tag == "tr" and self.row:
            self.rows.append((self.table, self.row))
            self.row = []


def html_rows(html: str | None, header: bool = True) -> list[tuple[int, list[str]]]:
    """(number of the table from 0, cell texts) of each row, with header cells or without; broken pages give the rows that can be read."""
    p = _Tables()
    p.header = header
    p.feed(html or "")
    p.close()
    return p.rows


def html_tables(pages: DataFrame, key: str, column: str = "html", least_cells: int = 1) -> DataFrame:
    """(key, table_no, row_no, cells) of all tables of each page, parsed in Arrow batches."""
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for b in batches:
            out = [(k, t, i, c) for k, h in zip(b[key], b[column]) for i, (t, c) in enumerate(html_rows(h)) if len(c) >= least_cells]
            yield pd.DataFrame(out, columns=[key, "table_no", "row_no", "cells"])

    return pages.select(key, column).mapInPandas(run, f"{key} {kind}, table_no int, row_no int, cells array<string>")


def write_tabs(folder: str, tabs: dict[str, DataFrame], fmt: str = "parquet") -> None:
    """Each tab of a report as a folder of its own, written by the executors."""
    for name, df in tabs.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{folder}/{name}")


def table_json(df: DataFrame, most: int = 2000) -> dict:
    """{columns, records} of a preview for an interface; a report is written by write_tabs."""
    return {"columns": df.columns, "records": [r.asDict(recursive=True) for r in df.limit(most).collect()]}

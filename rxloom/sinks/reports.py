"""Reports as workbooks, folders of tabs and files, and their delivery.

Large tabs are folders that the executors write (sources.files.write_tabs). A workbook is one file, so its rows come to the
driver; they come one partition after the other and go straight into the archive, so that no tab is held there.
"""

from __future__ import annotations

import csv
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions import xlsx
from rxloom.functions.requests import header, period_label, period_tag
from rxloom.operators.grader import report
from rxloom.operators.relational import pruned
from rxloom.sources.files import write_tabs

RECON = ["status", "combined_molecule", "product", "manufacturer", "strength", "din", "top_score", "second_score"]


def workbook(path: str, tabs: dict[str, DataFrame]) -> None:
    """Tabs with display headers; rows are streamed."""
    xlsx.write(path, {n: ([header(c) for c in df.columns], (tuple(map(xlsx.cell, r)) for r in df.toLocalIterator())) for n, df in tabs.items()})


def mart_workbook(path: str, sheet: DataFrame, filings: DataFrame, status: DataFrame | None = None, keep: tuple[str, ...] = ("din",)) -> None:
    """The mart without its nearly empty columns, by product number, the filings, and how each source did."""
    tabs = {"Products": pruned(sheet, keep=keep).orderBy("din"), "Filings": filings}
    workbook(path, tabs | ({"Sources": status} if status is not None else {}))


def stacked_mart(marts: dict[str, DataFrame], order: list[str]) -> DataFrame:
    """Marts of several products under each other, with the product that each row is of; columns in order, the others after."""
    one = [df.withColumn("ingredient_name", F.lit(n)) for n, df in marts.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one)
    names = ["ingredient_name", *order]
    return out.select(*[c for c in names if c in out.columns], *[c for c in out.columns if c not in names])


def filtered_workbook(path: str, products: DataFrame, sheet: DataFrame, chosen: DataFrame) -> None:
    """Products that a screen left, and the rows of their product numbers."""
    detail = sheet.join(chosen.select("din").distinct(), "din", "left_semi").orderBy("din")
    workbook(path, {"Summary": products, "Detail": detail})


def comparison_tabs(compared: DataFrame, old: tuple[int, int] | None, new: tuple[int, int] | None) -> dict[str, DataFrame]:
    """Summary, entrants, exits and moves of compare_periods, metrics named by their period."""
    names = {c: f"{c[4:]} {period_label(old if c.startswith('old_') else new)}" for c in compared.columns if c.startswith(("old_", "new_"))}
    tabs = {"Summary": compared.groupBy("signal").agg(F.count("*").alias("n")).orderBy("signal")}
    for tab, signal in (("Entrants", "entrant"), ("Exits", "exit"), ("Moves", "move")):
        tabs[tab] = compared.where(F.col("signal") == signal).drop("signal").withColumnsRenamed(names)
    return tabs


def comparison_name(old: tuple[int, int] | None, new: tuple[int, int] | None) -> str:
    return f"comparison_{period_tag(old)}_{period_tag(new)}.xlsx"


def recon_tab(found: DataFrame) -> DataFrame:
    """One row per decision of the matcher, what is to be looked at first."""
    rank = F.when(F.col("status") == "ambiguous", 0).when(F.col("status") == "low_score", 1).when(F.col("status") == "matched", 2).otherwise(3)
    return found.select(*RECON).orderBy(rank, F.desc("top_score"), *RECON[1:6])


def exclusion_rows(path: str, excluded: DataFrame) -> None:
    """A CSV file of one part, streamed."""
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(map(header, excluded.columns))
        out.writerows(map(tuple, excluded.toLocalIterator()))


def deliver(tabs: dict[str, DataFrame], lake: str, name: str, now: datetime) -> str:
    """Writes the tabs to any file system that Spark knows, in a folder named by the time; gives its path."""
    folder = f"{lake.rstrip('/')}/{name}_{now:%Y%m%d_%H%M%S}"
    write_tabs(folder, tabs)
    return folder


def findings_report(path: str, found: DataFrame) -> None:
    """A Markdown summary at path and all findings as CSV beside it."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(report(found))
    exclusion_rows(path.rsplit(".", 1)[0] + ".csv", found)

"""What an interface calls: searches, marts, screens and comparisons by name, each a DataFrame or a file.

A bundle keeps the DataFrames that several requests share; nothing runs until one is asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from rxloom.functions.requests import ordered_periods, queries
from rxloom.operators import sales
from rxloom.plans import market
from rxloom.sinks import reports
from rxloom.sources.files import sales_extract, table_json
from rxloom.sources.tables import table


@dataclass
class Bundle:
    """The tables of a folder, and when it was opened."""

    spark: SparkSession
    folder: str
    built_at: datetime = field(default_factory=datetime.now)
    kept: dict[str, DataFrame] = field(default_factory=dict)

    def get(self, name: str) -> DataFrame:
        if name not in self.kept:
            self.kept[name] = table(self.spark, self.folder, name)
        return self.kept[name]

    def is_fresh(self, now: datetime, hours: float = 4) -> bool:
        return (now - self.built_at).total_seconds() <= hours * 3600

    def reset(self) -> None:
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()


def search(b: Bundle, text: str, by: str = "ingredient", synonyms: dict[str, list[str]] | None = None, most: int = 150) -> dict[str, DataFrame]:
    """Catalogue records and approvals of the terms of a query; synonyms of a term are searched with it."""
    asked = queries(text)
    terms = queries([*asked, *(s for t in asked for s in (synonyms or {}).get(t.lower(), []))])
    if not terms:
        raise ValueError("nothing is asked for")
    how = {"ingredient": {"terms": terms}, "brand": {"terms": [], "brands": terms}, "company": {"terms": [], "companies": terms}}[by]
    out = {"catalogue": market.search_catalogue(b.get("activeingredient"), b.get("drugproduct"), most=most, **how)}
    if by == "ingredient":
        found = [market.search_approvals(b.get("api_medicinalingredient"), b.get("api_main"), t) for t in terms]
        for f in found[1:]:
            found[0] = found[0].unionByName(f)
        out["approvals"] = found[0].distinct()
    return out


def mart(b: Bundle, everything: bool = True) -> DataFrame:
    return (market.mart_union if everything else market.mart_inner)(b.spark, b.folder)


def export(b: Bundle, path: str) -> None:
    reports.mart_workbook(path, mart(b), market.approval_search(b.spark, b.folder))


def exclusions(b: Bundle, path: str) -> None:
    reports.exclusion_rows(path, market.exclusions(b.spark, b.folder))


def preview(b: Bundle, name: str, make: Callable[[SparkSession, str], DataFrame], most: int = 2000) -> dict:
    return {"name": name, **table_json(make(b.spark, b.folder), most)}


def compare_files(spark: SparkSession, old: str, new: str, path: str, keys: list[str]) -> list[str]:
    """Compares two extracts by the latest period that each has and writes the workbook; gives the warnings.

    Files given the wrong way round change places. A metric that a file lacks counts 0.
    """
    sides = [sales_extract(spark, p) for p in (old, new)]
    latest = [max((p for _, p in m.values()), default=None) for _, m in sides]
    swap, warnings = ordered_periods(*latest)
    if swap:
        sides, latest = sides[::-1], latest[::-1]
        warnings.append("the files were given the wrong way round")
    from pyspark.sql import functions as F

    one = []
    for (df, metrics), period in zip(sides, latest):
        columns = {m: c for c, (m, p) in metrics.items() if p == period}
        one.append(sales.collapse(df, [F.col(f"`{k}`") for k in keys], {m: F.col(f"`{columns[m]}`") if m in columns else F.lit(0) for m in ("dollars", "units")}))
    reports.workbook(path, reports.comparison_tabs(sales.compare_periods(one[0], one[1], keys, ["dollars", "units"]), *latest))
    return warnings

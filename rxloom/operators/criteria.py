"""Screens on numeric, form and date criteria, built on the driver and pushed into one filter."""

from __future__ import annotations

import operator
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = {"above": operator.gt, "below": operator.lt, "exactly": operator.eq}


def parse_criteria(rows: list[dict], allowed: set[str]) -> list[tuple[str, str, float]]:
    """Typed criteria of (metric, op, value) rows; blank rows are skipped, anything unknown or non-numeric raises."""
    out = []
    for r in rows:
        metric, op, value = (str(r.get(k) or "").strip() for k in ("metric", "op", "value"))
        if not (metric and op and value):
            continue
        if metric not in allowed or op not in OPS:
            raise ValueError(f"unknown criterion: {metric} {op}")
        out.append((metric, op, float(value.replace(",", ""))))
    return out


def numeric(criteria: list[tuple[str, str, float]]) -> Column:
    return reduce(operator.and_, [OPS[op](F.coalesce(F.col(m).cast("double"), F.lit(0.0)), F.lit(v)) for m, op, v in criteria], F.lit(True))


def any_form(forms: Column, chosen: list[str]) -> Column:
    """Any of the forms of a field, split at semicolons, has a chosen base."""
    from rxloom.functions.names import base_form

    return F.exists(F.split(forms, ";"), lambda f: base_form(F.trim(f)).isin([c.upper() for c in chosen]))


def by_date(c: Column, op: str, day: date) -> Column:
    """less, greater, greater_or_equal or equal; a missing date passes `less` only."""
    d = F.lit(day)
    test = {"less": c < d, "greater": c > d, "greater_or_equal": c >= d, "equal": c == d}[op]
    return F.coalesce(test, F.lit(op == "less"))


def screen(df: DataFrame, criteria: list[tuple[str, str, float]], *more: Column) -> DataFrame:
    return df.where(reduce(operator.and_, more, numeric(criteria)))

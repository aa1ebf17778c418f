"""What a caller asks for, made sound on the driver: queries, dates, periods, headers, progress."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headers that aren't the title case of their column.
HEADERS = {"din": "DIN", "brand_name": "SKU Name"}
#: Parts of the whole that the stages of a job take.
STAGES = (("Search", 0.00, 0.20), ("Patents", 0.20, 0.50), ("Labeling", 0.50, 0.85), ("DataProtection", 0.85, 0.90), ("Workbook", 0.90, 1.00))


def queries(text: str | Iterable[str]) -> list[str]:
    """Terms of a box, by lines or else by commas, or of a list; each once whatever its letter case, in order."""
    parts = (text.split("\n") if "\n" in text else text.split(",")) if isinstance(text, str) else text
    out: dict[str, str] = {}
    for p in parts:
        if p and (t := " ".join(p.split())):
            out.setdefault(t.lower(), t)
    return list(out.values())


def future_date(text: str, today: date) -> date:
    """A day as MM/DD/YYYY, later than today; anything else raises."""
    if not re.fullmatch(r"\d{2}/\d{2}/\d{4}", text.strip()):
        raise ValueError(f"not MM/DD/YYYY: {text}")
    day = datetime.strptime(text.strip(), "%m/%d/%Y").date()
    if day <= today:
        raise ValueError(f"not after {today:%m/%d/%Y}: {text}")
    return day


def period_label(period: tuple[int, int] | None) -> str:
    return f"{period[0]:04d}/{period[1]:02d}" if period else "—"


def period_tag(period: tuple[int, int] | None) -> str:
    return f"{period[0]:04d}-{period[1]:02d}" if period else "NA"


def ordered_periods(old: tuple[int, int] | None, new: tuple[int, int] | None) -> tuple[bool, list[str]]:
    """(whether the two files must change places, warnings); a file without a period raises."""
    if old is None or new is None:
        raise ValueError("a file has no metric period")
    return old > new, ["both files have the same period"] if old == new else []


def header(column: str) -> str:
    return HEADERS.get(column, column.replace("_", " ").title())


def stage_share(stage: str, done: int, total: int) -> float:
    """How much of a job is done: within its stage in proportion."""
    low, high = next((a, b) for s, a, b in STAGES if s == stage)
    return round(low + (high - low) * (done / total if total > 0 else 1.0), 3)


def seconds_left(done: int, total: int, spent: float) -> float | None:
    """At the rate so far; None before anything is done."""
    return None if not (done and total and spent) else round((total - done) * spent / done, 1)


def expanded(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(term, search_term) of terms and of the words that stand for them in a table (term, synonym), in lower case, each once.

    Nulls are left out; a term without synonyms is itself.
    """
    t = terms.select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()
    s = synonyms.select(F.lower(F.trim("term")).alias("term"), F.lower(F.trim("synonym")).alias("search_term")).where("search_term <> ''")
    return t.select("term", F.col("term").alias("search_term")).union(t.join(s, "term").select("term", "search_term")).distinct()

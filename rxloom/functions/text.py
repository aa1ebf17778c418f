"""Column builders shared by the operators; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every kind, the no-break and thin spaces included.
BLANKS = r"[\s  -​ 　]+"


def squeeze(c: Column) -> Column:
    """Blanks of any kind become one space; outer ones go."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def amount(c: Column) -> Column:
    """Typed number of an amount in any of the extract's notations.

    Blank, null and a lone dash are 0; currency signs, grouping commas and blanks go; round brackets or a leading
    dash make it negative. What is still no number gives null.
    """
    bare = F.regexp_replace(F.regexp_replace(no_blanks(c), r"[$,]", ""), r"[−–—]", "-")
    plain = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(c.isNull() | bare.isin("", "-"), F.lit(0.0)).otherwise(plain.try_cast("double"))


def normalize_din(c: Column) -> Column:
    """Digits only, left-padded to 8; longer ones stay as they are, none give null."""
    d = F.regexp_replace(c, r"\D", "")
    return F.when(d == "", F.lit(None)).when(F.length(d) >= 8, d).otherwise(F.lpad(d, 8, "0"))


#: Java date patterns tried in turn, each behind the shape that it fits. Numeric dates with slashes are month/day/year.
DATE_SHAPES = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{4} \d{1,2} \d{1,2}$", "y M d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM y"),
    (r"^\d{1,2} [A-Z][a-z]{3,} \d{4}$", "d MMMM y"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, y"),
    (r"^[A-Z][a-z]{3,} \d{1,2}, \d{4}$", "MMMM d, y"),
]


def any_date(c: Column) -> Column:
    """Date of any of the notations; blank, `N/A`-like and impossible entries give null.

    Month names count in any letter case and with a full stop after a short form; May fits both month shapes.
    """
    t = F.initcap(F.regexp_replace(squeeze(c), r"(?<=[A-Za-z])\.", ""))
    t = F.regexp_replace(t, r"\bSept\b", "Sep")
    out = F.lit(None).cast("date")
    for shape, pattern in reversed(DATE_SHAPES):
        out = F.when(t.rlike(shape), F.try_to_date(t, pattern)).otherwise(out)
    return out

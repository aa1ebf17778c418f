"""Data-quality findings: each check is one expression, all checks run in one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.names import real_value


def findings(df: DataFrame, key: str, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(key, check_id, field, severity, value) of every failed check (check_id, field, severity, fails)."""
    cases = F.array(*[F.struct(F.lit(i).alias("check_id"), F.lit(f).alias("field"), F.lit(s).alias("severity"), F.col(f).cast("string").alias("value"), F.coalesce(c, F.lit(False)).alias("fails")) for i, f, s, c in checks])
    return df.select(key, F.inline(F.filter(cases, lambda c: c["fails"]))).drop("fails")


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))


def label_checks() -> list[tuple[str, str, str, Column]]:
    """Checks of label fields: sizes between 2 and 30 mm, pH between 0 and 14, weights with a unit, styles without digits, sentinels."""
    size, ph, weight, style = (F.col(c) for c in ("size_mm", "ph", "weight", "pack_style"))
    return [
        ("size_format", "size_mm", "ERROR", real_value(size) & ~size.rlike(r"^\d+(\.\d+)?( x \d+(\.\d+)?)*$")),
        ("size_range", "size_mm", "WARN", real_value(size) & F.exists(numbers(size), lambda x: (x < 2) | (x > 30))),
        ("ph_format", "ph", "ERROR", real_value(ph) & ~ph.rlike(r"^\d+(\.\d+)?(-\d+(\.\d+)?)?$")),
        ("ph_range", "ph", "ERROR", real_value(ph) & F.exists(numbers(ph), lambda x: x > 14)),
        ("weight_unit", "weight", "WARN", real_value(weight) & ~weight.rlike(r"(?i)\d\s*(g|mg)$")),
        ("style_digit", "pack_style", "WARN", real_value(style) & style.rlike(r"\d|:")),
        *[(i, c, "INFO", F.col(c).isNotNull() & ~real_value(F.col(c))) for i, c in (("color_blank", "color"), ("shape_blank", "shape"), ("pack_blank", "pack_size"))],
    ]


def summary(found: DataFrame) -> DataFrame:
    """Findings by check and severity."""
    return found.groupBy("check_id").pivot("severity", ["ERROR", "WARN", "INFO"]).count().na.fill(0)


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, only_a, only_b) where the sets of two sources, arrays named names, differ; keys of both only."""
    j = a.select(key, F.col("names").alias("a")).join(b.select(key, F.col("names").alias("b")), key)
    return j.select(key, F.array_join(F.array_sort(F.array_except("a", "b")), "; ").alias("only_a"), F.array_join(F.array_sort(F.array_except("b", "a")), "; ").alias("only_b")).where("only_a <> '' OR only_b <> ''")


def coherence_checks() -> list[tuple[str, str, str, Column]]:
    """Fields of one label that contradict each other: real values beside `no document`, half of a descriptor."""
    fields = ("nonmedicinal_ingredients", "pack_size", "pack_style", "color", "shape", "size_mm", "weight", "ph")
    real = {f: real_value(F.col(f)) for f in (*fields, "active_ingredient")}
    none = {f: F.coalesce(F.lower(F.trim(f)) == "no pm available", F.lit(False)) for f in fields}
    any_of = lambda d: F.exists(F.array(*d), lambda x: x)
    return [
        ("mixed_sentinel", "pdf_url", "ERROR", any_of([real[f] for f in fields]) & any_of(list(none.values()))),
        ("ingredient_blank", "active_ingredient", "ERROR", F.col("drug_code").isNotNull() & ~real["active_ingredient"]),
        ("no_appearance", "color", "WARN", real["nonmedicinal_ingredients"] & ~real["color"] & ~real["shape"]),
        ("weight_without_size", "size_mm", "WARN", real["weight"] & ~real["size_mm"]),
        ("size_without_weight", "weight", "WARN", real["size_mm"] & ~real["weight"]),
    ]

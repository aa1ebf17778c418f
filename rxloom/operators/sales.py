"""Sales metrics: collapse to products, comparison of two periods, presence and material moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as a material move.
LEAST_DOLLARS, LEAST_UNITS, LEAST_PART = 100_000, 1_000, 0.10


def collapse(df: DataFrame, keys: list[Column], metrics: dict[str, Column], provenance: str | None = None) -> DataFrame:
    """Sums of the metrics by keys, and the ids of the rows in order, if asked for."""
    aggs = [F.sum(c).alias(n) for n, c in metrics.items()]
    if provenance:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_list(provenance)), lambda x: x.cast("string")), ", ").alias("source_rows"))
    return df.groupBy(*keys).agg(*aggs)


def present(*metrics: Column) -> Column:
    """Any metric above 0."""
    out = F.coalesce(metrics[0], F.lit(0)) > 0
    for m in metrics[1:]:
        out = out | (F.coalesce(m, F.lit(0)) > 0)
    return out


def material(old: Column, new: Column, least: float) -> Column:
    """Far enough in size and in part; a base of 0 is infinitely small."""
    d = F.abs(new - old)
    return (d >= least) & ((old == 0) | (d >= LEAST_PART * old))


def change_percent(old: Column, new: Column) -> Column:
    return F.when(old != 0, F.round((new - old) / old * 100, 1))


def compare_periods(old: DataFrame, new: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Full outer join on the identity with old_ and new_ metrics, signal (entrant, exit, move or none) and changes."""
    o = old.select(*keys, *[F.col(m).alias(f"old_{m}") for m in metrics])
    n = new.select(*keys, *[F.col(m).alias(f"new_{m}") for m in metrics])
    both = o.join(n, keys, "full_outer").na.fill(0, [f"{p}_{m}" for p in ("old", "new") for m in metrics])
    was, is_ = present(*[F.col(f"old_{m}") for m in metrics]), present(*[F.col(f"new_{m}") for m in metrics])
    moved = material(F.col("old_dollars"), F.col("new_dollars"), LEAST_DOLLARS) | material(F.col("old_units"), F.col("new_units"), LEAST_UNITS)
    signal = F.when(~was & is_, "entrant").when(was & ~is_, "exit").when(was & is_ & moved, "move").when(was & is_, "steady")
    return both.withColumn("signal", signal).where("signal IS NOT NULL").withColumn("dollars_percent", change_percent(F.col("old_dollars"), F.col("new_dollars")))


def with_group_total(df: DataFrame, group: list[str], metric: str) -> DataFrame:
    return df.withColumn("group_total", F.sum(metric).over(Window.partitionBy(*group)))

"""Keyed operators: first and latest rows, upserts, set operations, fill rates, samples, containment joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given order; null keys form a key of their own."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not delivered again, and the new rows: the last write wins."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def stale_keys(wanted: DataFrame, stored: DataFrame, key: str, fetched: str, before: Column) -> DataFrame:
    """Keys never fetched, or last fetched before the given time."""
    last = stored.groupBy(key).agg(F.max(fetched).alias("last_fetched"))
    return wanted.select(key).distinct().join(last, key, "left").where(F.col("last_fetched").isNull() | (F.col("last_fetched") < before))


def fill_rates(df: DataFrame, filled=None) -> DataFrame:
    """(column_name, fill_rate) in one pass over all columns."""
    filled = filled or (lambda c: c.isNotNull() & (F.trim(c.cast("string")) != ""))
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(filled(F.col(c))).alias(c) for c in df.columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(F.col(c) / F.greatest("_n", F.lit(1)), 6).alias("fill_rate")) for c in df.columns])).alias("x")).select("x.*")


def pruned(df: DataFrame, least: float = 0.02, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without the columns filled in no more than the given part of the rows, but for those to keep."""
    rates = {r.column_name: r.fill_rate for r in fill_rates(df).collect()}
    return df.select(*[c for c in df.columns if c in keep or rates[c] > least])


def master_rows(key: str, sources: dict[str, DataFrame]) -> DataFrame:
    """One row per key with the rows of each source as an array of structs; a single shuffle of the union."""
    tagged = []
    for name in sources:
        parts = [F.struct(*[F.col(c) for c in sorted(d.columns) if c != key]).alias("r") if n == name else F.lit(None).cast(_struct(d, key)).alias("r") for n, d in sources.items()]
        tagged.append(sources[name].select(key, *[p.alias(n) for n, p in zip(sources, parts)]))
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(*[F.array_sort(F.collect_list(n)).alias(n) for n in sources])


def _struct(d: DataFrame, key: str):
    from pyspark.sql.types import StructType

    return StructType(sorted((f for f in d.schema.fields if f.name != key), key=lambda f: f.name))


def containment_pairs(a: DataFrame, b: DataFrame, gram: int = 6) -> DataFrame:
    """(a, b) where one text holds the other. a, b: one distinct, non-null text column each, named a and b.

    The shorter text's first characters must occur in the longer one: an equi-join on them stands for the test of all
    pairs, and the test itself follows. Texts shorter than the gram join by their whole length.
    """

    def anchors(d: DataFrame, c: str) -> DataFrame:
        return d.where(F.length(c) > 0).select(c, F.substring(c, 1, gram).alias("g"))

    def grams(d: DataFrame, c: str) -> DataFrame:
        at = F.sequence(F.lit(1), F.length(c))
        every = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda k: F.substring(F.col(c), i, k))))
        return d.where(F.length(c) > 0).select(c, F.explode(F.array_distinct(every)).alias("g"))

    one = anchors(a, "a").join(grams(b, "b"), "g").where(F.contains("b", F.col("a")))
    two = anchors(b, "b").join(grams(a, "a"), "g").where(F.contains("a", F.col("b")))
    return one.select("a", "b").union(two.select("a", "b")).distinct()


def stratified_sample(df: DataFrame, stratum: str, key: str, quota: int) -> DataFrame:
    """Up to quota rows of each stratum, drawn by a hash of the key: the same rows whatever the partitions."""
    n = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key))
    return df.withColumn("_n", n).where(F.col("_n") <= quota).drop("_n")

"""Differences between two copies of a table by invertible Bloom lookup tables.

A table holds (key, row hash) pairs in one cell of each of HASHES sub-tables. A cell keeps a count and the xor of keys, of
row hashes and of check sums: all are built-in aggregates. The copies are subtracted by their sign in the same
aggregation; what is left are the pairs of one copy only, which peeling reveals one by one.

How many pairs differ is estimated first, by small tables of strata of the keys, each stratum half as likely as the one
before. The tables are then sized by that estimate, not by the copies: keys are hashed into buckets that hold about
LOAD differences each. A bucket lies in one partition of rows hashed by their key, so what is shuffled are the cells
alone. A bucket that doesn't peel empty is tried again with more cells, and after that goes the exact way: all its keys
count as candidates. Values are fetched and compared field by field only for candidate keys.
"""

from __future__ import annotations

from math import ceil, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.session import cut

HASHES = 3
#: Strata of the estimate, and cells of each sub-table of one.
STRATA, STRATUM_CELLS = 32, 27
#: Differences that a bucket is meant to hold, and the growth of its cells if it doesn't peel.
LOAD, GROWTH = 64, 4
PEELED = "bucket long, key long, sign int, whole boolean"


def bucket_of(buckets: int) -> Column:
    """By the hash that partitions rows by key, so that with as many buckets as partitions, or a multiple, none is in two."""
    return F.pmod(F.hash("key"), F.lit(buckets)).cast("long")


def stratum() -> Column:
    """Zeros at the end of a hash of the key: half of all keys have none, a quarter one, and so on."""
    h = F.xxhash64(F.lit(7), "key")
    return F.least(F.length(F.regexp_extract(F.conv(F.hex(h), 16, 2), "(0*)$", 1)), F.lit(STRATA - 1)).cast("long")


def cell_table(df: DataFrame, sign: int, bucket: Column, cells: int) -> DataFrame:
    """Rows of (bucket, cell, key, hash, check, sign): one for each sub-table."""
    pair = df.select("key", "digest", F.xxhash64(F.lit(77), "key", "digest").alias("check"))
    cell = [(F.pmod(F.xxhash64(F.lit(j + 1), "key", "digest"), F.lit(cells)) + j * cells).cast("int") for j in range(HASHES)]
    return pair.select(bucket.alias("bucket"), F.explode(F.array(*cell)).alias("cell"), "key", "digest", "check", F.lit(sign).alias("sign"))


def subtract(a: DataFrame, b: DataFrame, bucket: Column, cells: int) -> DataFrame:
    """Cells of a minus b that aren't empty. a, b: (key long, digest long), keys unique in each."""
    return (
        cell_table(a, 1, bucket, cells)
        .unionByName(cell_table(b, -1, bucket, cells))
        .groupBy("bucket", "cell")
        .agg(F.sum("sign").cast("long").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("digest").alias("digest"), F.bit_xor("check").alias("check"))
        .where((F.col("n") != 0) | (F.col("key") != 0) | (F.col("digest") != 0) | (F.col("check") != 0))
        # what a pure cell must satisfy is computed by the same engine hash, for the cell as it stands
        .withColumn("sound", F.col("n").isin(1, -1) & (F.xxhash64(F.lit(77), "key", "digest") == F.col("check")))
    )


def _mix64(x: int) -> int:
    return x & 0xFFFFFFFFFFFFFFFF


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & 0xFFFFFFFFFFFFFFFF


P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _xx_long(v: int, seed: int) -> int:
    """The published XXH64 of one 8-byte word, which Spark's xxhash64 chains over its arguments."""
    h = _mix64(seed + P5 + 8)
    h ^= _mix64(_rotl(_mix64(_mix64(v) * P2), 31) * P1)
    h = _mix64(_rotl(h, 27) * P1 + P4)
    return _final(h)


def _xx_int(v: int, seed: int) -> int:
    h = _mix64(seed + P5 + 4)
    h ^= _mix64((v & 0xFFFFFFFF) * P1)
    h = _mix64(_rotl(h, 23) * P2 + P3)
    return _final(h)


def _final(h: int) -> int:
    h ^= h >> 33
    h = _mix64(h * P2)
    h ^= h >> 29
    h = _mix64(h * P3)
    return h ^ (h >> 32)


def spark_hash(tag: int, key: int, digest: int) -> int:
    """xxhash64(int tag, long key, long digest) as a signed long, as Spark gives it."""
    h = _xx_long(digest, _xx_long(key, _xx_int(tag, 42)))
    return h - (1 << 64) if h >= 1 << 63 else h


def peel(cells: pd.DataFrame, width: int) -> tuple[list[tuple[int, int]], bool]:
    """((key, sign) pairs, whether the bucket came out empty)."""
    table = {int(r[0]): [int(x) for x in r[1:]] for r in cells[["cell", "n", "key", "digest", "check"]].itertuples(index=False)}
    ready = [int(c) for c in cells.loc[cells["sound"], "cell"]]
    out: list[tuple[int, int]] = []
    while ready:
        at = ready.pop()
        cell = table.get(at)
        if cell is None or cell[0] not in (1, -1) or spark_hash(77, cell[1], cell[2]) != cell[3]:
            continue
        n, key, digest, check = cell
        out.append((key, n))
        for j in range(HASHES):
            c = spark_hash(j + 1, key, digest) % width + j * width
            other = table.setdefault(c, [0, 0, 0, 0])
            other[0] -= n
            other[1] ^= key
            other[2] ^= digest
            other[3] ^= check
            if not any(other):
                del table[c]
            elif other[0] in (1, -1):
                ready.append(c)
    return out, not table


def estimated(a: DataFrame, b: DataFrame) -> int:
    """About how many pairs are in one copy only: the rarest strata that peel, scaled up. At most STRATA x HASHES x
    STRATUM_CELLS cells reach the driver, whatever the copies."""
    cells = subtract(a, b, stratum(), STRATUM_CELLS).toPandas()
    by, found = dict(iter(cells.groupby("bucket"))), 0
    for level in range(STRATA - 1, -1, -1):
        pairs, whole = peel(by[level], STRATUM_CELLS) if level in by else ([], True)
        if not whole:
            return max(1, found) << (level + 1)
        found += len(pairs)
    return found


def sized(differences: int, parts: int) -> tuple[int, int]:
    """(buckets, cells of a sub-table) for so many differences: buckets in multiples of the partitions, cells with room for
    buckets that chance makes fuller."""
    buckets = parts * max(1, ceil(differences / (LOAD * parts)))
    load = differences / buckets
    return buckets, max(4, ceil((load + 4 * sqrt(load) + 4) * 1.5 / HASHES))


def differing_keys(a: DataFrame, b: DataFrame, buckets: int, cells: int) -> DataFrame:
    """(bucket, key, sign, whole): keys whose pair is in one copy only; a row with null key and whole false for each
    bucket that didn't peel empty, whose decoded keys may be incomplete.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found, whole = peel(pdf, cells)
        rows = [(k, s, True) for k, s in found] if whole else [(None, 0, False)]
        out = pd.DataFrame(rows, columns=["key", "sign", "whole"])
        out.insert(0, "bucket", int(pdf["bucket"].iloc[0]))
        return out.astype({"key": "Int64"})

    return subtract(a, b, bucket_of(buckets), cells).groupBy("bucket").applyInPandas(run, PEELED)


def compare_copies(left: DataFrame, right: DataFrame, fields: list[str], names: tuple[str, str] = ("left", "right"), size: tuple[int, int] | None = None) -> DataFrame:
    """(key, difference, left_value, right_value): `missing_in_<name>` or the field that differs, null against none too.

    left, right: key long, unique and not null, and the fields. size: buckets and cells, by default by the estimate. Extra
    columns are ignored. Two empty copies give no rows.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    digest = F.xxhash64(*[x for c in fields for x in (F.col(c), F.col(c).isNull())])
    # each is read several times below
    sides = [cut(s.select("key", digest.alias("digest"), *fields)) for s in (left, right)]
    pairs = [s.select("key", "digest") for s in sides]
    buckets, cells = size or sized(estimated(*pairs), parts)
    found = cut(differing_keys(*pairs, buckets, cells))
    failed = found.where("NOT whole").select("bucket").distinct()
    candidates, rest = found.where("whole").select("key"), None
    if not failed.isEmpty():
        within = lambda d, some: d.withColumn("bucket", bucket_of(buckets)).join(some, "bucket", "left_semi").drop("bucket")
        again = cut(differing_keys(*[within(p, failed) for p in pairs], buckets, cells * GROWTH))
        candidates = candidates.unionByName(again.where("whole").select("key"))
        rest = again.where("NOT whole").select("bucket").distinct()
    candidates, fetched = candidates.distinct(), []
    for s in sides:
        rows = s.join(candidates, "key", "left_semi")
        if rest is not None:
            rows = rows.unionByName(within(s, rest))
        fetched.append(rows.select("key", F.struct(*fields).alias("v")))
    both = fetched[0].withColumnRenamed("v", "l").join(fetched[1].withColumnRenamed("v", "r"), "key", "full_outer")
    cases = [
        F.struct(F.when(F.col("l").isNull(), f"missing_in_{names[0]}").when(F.col("r").isNull(), f"missing_in_{names[1]}").alias("difference"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value"))
    ] + [
        F.struct(
            F.when(F.col("l").isNotNull() & F.col("r").isNotNull() & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}")), f).alias("difference"),
            F.col(f"l.{f}").cast("string").alias("left_value"),
            F.col(f"r.{f}").cast("string").alias("right_value"),
        )
        for f in fields
    ]
    return both.select("key", F.inline(F.filter(F.array(*cases), lambda c: c["difference"].isNotNull())))

"""Changes between consecutive full snapshots of a table.

The last loaded row of each key in each snapshot is found by a partial aggregation, so that a key delivered any number
of times sends one row per map task. What is shuffled is a compact triple (snapshot, key, 64-bit hash of the compared
values), hash-bucketed by key. Each bucket is a task that sorts its arrays in numpy and takes set differences by
searchsorted for each pair of consecutive snapshots. Full values are fetched only for the keys that differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.arrow import arrow_schema

KINDS = np.array(["added", "removed", "changed"])
#: Rows that a bucket's task is meant to hold at most: three arrays of numbers.
BUCKET_ROWS = 2_000_000
CHANGES = "snapshot_no int, key long, change_kind string"


def latest_rows(df: DataFrame, snapshot: str, key: str, loaded: str, tie: str, **values: Column) -> DataFrame:
    """One row per (snapshot, key): of the row loaded last, by the highest tie column among equals.

    Rows without snapshot or key belong to no line and are left out. A null load time is the earliest.
    """
    kept = df.where(F.col(snapshot).isNotNull() & F.col(key).isNotNull())
    order = F.struct(F.col(loaded).alias("_l"), F.col(tie).alias("_t"), *[c.alias(n) for n, c in values.items()])
    return (
        kept.groupBy(F.col(snapshot).cast("int").alias("snapshot_no"), F.col(key).cast("long").alias("key"))
        .agg(F.max(order).alias("_m"))
        .select("snapshot_no", "key", *[F.col(f"_m.{n}").alias(n) for n in values])
    )


def diff_arrays(snap: np.ndarray, key: np.ndarray, digest: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later snapshot, key, kind 0..2) of one bucket; keys are unique within a snapshot."""
    by = np.lexsort((key, snap))
    snap, key, digest = snap[by], key[by], digest[by]
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def of(n: int) -> slice:
        return slice(*np.searchsorted(snap, [n, n + 1]))

    for before, after in zip(order, order[1:]):
        k0, h0, k1, h1 = key[of(before)], digest[of(before)], key[of(after)], digest[of(after)]
        at = np.searchsorted(k0, k1)
        inside = at < len(k0)
        both = np.zeros(len(k1), bool)
        both[inside] = k0[at[inside]] == k1[inside]
        changed = np.zeros(len(k1), bool)
        changed[both] = h0[at[both]] != h1[both]
        gone = np.ones(len(k0), bool)
        gone[at[both]] = False
        for kind, keys in enumerate((k1[~both], k0[gone], k1[changed])):
            parts.append((np.full(len(keys), after, np.int32), keys, np.full(len(keys), kind, np.int8)))
    if not parts:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int8)
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def snapshot_changes(latest: DataFrame, compared: list[str], snapshots: list[int], rows: int = 0) -> DataFrame:
    """(snapshot_no, key, change_kind) for each pair of consecutive snapshots in the sorted list given.

    latest: what latest_rows gives. rows: about how many; buckets are added to the session's partitions as they need.
    Compared columns differ by value, null from everything but null. An empty table or
    a single snapshot gives no rows.
    """
    spark = latest.sparkSession
    target = arrow_schema(spark, CHANGES)
    digest = F.xxhash64(*[x for c in compared for x in (F.col(c), F.col(c).isNull())])
    compact = latest.select("snapshot_no", "key", digest.alias("digest"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        s, k, d = diff_arrays(*(t.column(c).to_numpy() for c in ("snapshot_no", "key", "digest")), snapshots)
        for i in range(0, len(s), 100_000):
            e = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(s[e]), pa.array(k[e]), pa.array(KINDS[d[e]], pa.string())], schema=target)

    return compact.repartition(parts, "key").mapInArrow(bucket, CHANGES)


def deliveries(df: DataFrame, snapshot: str) -> tuple[list[int], int]:
    """The delivery numbers, sorted, and the rows of all: one scan of one column; as many rows reach the driver as there are deliveries."""
    rows = df.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).cast("int")).count().collect()
    return sorted(r[0] for r in rows), sum(r[1] for r in rows)


def with_values(changes: DataFrame, latest: DataFrame, columns: list[str], snapshots: list[int]) -> DataFrame:
    """Old and new values of the differing keys only."""
    before = {b: a for a, b in zip(snapshots, snapshots[1:])}
    previous = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    c = changes.withColumn("previous_no", F.try_element_at(previous, "snapshot_no") if before else F.lit(None).cast("int"))
    new = latest.select("snapshot_no", "key", *[F.col(x).alias(f"{x}_new") for x in columns])
    old = latest.select(F.col("snapshot_no").alias("previous_no"), "key", *[F.col(x).alias(f"{x}_old") for x in columns])
    return c.join(new, ["snapshot_no", "key"], "left").join(old, ["previous_no", "key"], "left")

import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from rxloom.functions.text import amount, any_date, normalize_din
from rxloom.operators.snapshots import diff_arrays, deliveries, latest_rows, snapshot_changes, with_values

SCHEMA = "row_id long, line_key long, snapshot_no int, loaded_at timestamp, v string, extra string"


def changes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    order, rows = deliveries(df, "snapshot_no")
    assert rows == df.where("snapshot_no IS NOT NULL").count()
    latest = latest_rows(df, "snapshot_no", "line_key", "loaded_at", "row_id", v=F.col("v"))
    got = snapshot_changes(latest, ["v"], order)
    return sorted((r.snapshot_no, r.key, r.change_kind) for r in got.collect()), with_values(got, latest, ["v"], order)


def brute(rows):
    snaps = {}
    for rid, key, no, at, v, _ in rows:
        if key is None or no is None:
            continue
        old = snaps.setdefault(no, {}).get(key)
        if old is None or (at or dt.datetime.min, rid) > old[0]:
            snaps[no][key] = ((at or dt.datetime.min, rid), v)
    out, order = [], sorted(snaps)
    for a, b in zip(order, order[1:]):
        for k in snaps[a].keys() | snaps[b].keys():
            if k not in snaps[a]:
                out.append((b, k, "added"))
            elif k not in snaps[b]:
                out.append((b, k, "removed"))
            elif snaps[a][k][1] != snaps[b][k][1]:
                out.append((b, k, "changed"))
    return sorted(out)


def test_random_rows_against_brute_force(spark):
    rng = random.Random(1)
    rows = [
        (i, rng.choice([None, *range(40)]), rng.choice([1, 2, 4, 7, None]), rng.choice([None, dt.datetime(2024, 1, rng.randint(1, 3))]), rng.choice([None, "", "a", "b"]), "x")
        for i in range(900)
    ]
    got, full = changes(spark, rows)
    assert got == brute(rows)
    assert full.where("change_kind = 'changed' AND v_new <=> v_old").count() == 0


def test_late_rows_repeats_hot_key_and_empty(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, 5, 1, t, "a", None) for i in range(500)] + [(900, 5, 1, t + dt.timedelta(9), "late", None), (901, 5, 2, t, "late", None), (902, 6, 2, t, None, None)]
    assert changes(spark, rows)[0] == [(2, 6, "added")]
    assert changes(spark, [])[0] == []
    assert changes(spark, rows[:5])[0] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(-5, 5)), unique=True), st.randoms(use_true_random=False))
def test_diff_arrays_property(pairs, rng):
    digest = [rng.randint(0, 2) for _ in pairs]
    order = sorted({s for s, _ in pairs})
    s, k, d = diff_arrays(np.array([p[0] for p in pairs], np.int32), np.array([p[1] for p in pairs], np.int64), np.array(digest, np.int64), order)
    want = brute([(0, k, n, None, v, "") for (n, k), v in zip(pairs, digest)])
    assert sorted(zip(s.tolist(), k.tolist(), [("added", "removed", "changed")[x] for x in d])) == want


def test_amounts_dates_and_dins(spark):
    cases = {"1,234": 1234.0, " 1 234 ": 1234.0, "$1,234": 1234.0, "(12)": -12.0, "-12": -12.0, "12.50": 12.5, "-": 0.0, " - ": 0.0, "": 0.0, None: 0.0, "n/a": None, "1 234": 1234.0}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", amount(F.col("x")).alias("y")).collect()} == cases
    d = dt.date(2024, 4, 19)
    dates = {"2024-04-19": d, "2024 04 19": d, "20240419": d, "4/19/2024": d, "04/19/2024": d, "19 Apr 2024": d, "April 19, 2024": d, "19 APRIL 2024": d, "Apr. 19, 2024": d, "May 1, 2024": dt.date(2024, 5, 1), "N/A": None, "": None, None: None, "2024-13-45": None, "Not available": None}
    df = spark.createDataFrame([(k,) for k in dates], "x string")
    assert {r.x: r.y for r in df.select("x", any_date(F.col("x")).alias("y")).collect()} == dates
    dins = {"123": "00000123", "DIN 02345678": "02345678", "123456789": "123456789", "": None, None: None, "x": None}
    df = spark.createDataFrame([(k,) for k in dins], "x string")
    assert {r.x: r.y for r in df.select("x", normalize_din(F.col("x")).alias("y")).collect()} == dins

import itertools
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rxloom.functions.quantity import number, quantities, rounded
from rxloom.operators.units import PENALTY, convert_quantities, parse_quantities, segment

CASES = [
    ("160/12.5MG", None, [("mass", 160_000), ("mass", 12_500)]), ("5", "MG/5ML", [("mass_per_ml", 1000)]), ("10", "MG PER 5 ML", [("mass_per_ml", 2000)]), ("300", "1000 IU", [("activity", 300_000)]),
    ("2.5", "MG.ML-1", [("mass_per_ml", 2500)]), ("12,5mg/g", None, [("mass_per_g", 12_500)]), ("1.25 pct", None, [("mass_per_g", 12_500)]), ("0.5G/100G", None, [("mass_per_g", 5000)]),
    ("0.5G/0.3G", None, [("mass", 500_000), ("mass", 300_000)]), ("5mcg / 10MG", None, [("mass", 5), ("mass", 10_000)]), ("1,000,000 I.U.", None, [("activity", 1_000_000)]), (".3g", None, [("mass", 300_000)]),
    ("5", "MEQ", [None]), ("TRACE", "", []), (None, "MG", []), ("", None, []), ("10", None, [None]), ("9MG", "MG", [("mass", 9000)]), ("5 + 10", "MG", [("mass", 5000), ("mass", 10_000)]),
    ("1,500", "MCG", [("mass", 1500)]), ("1,5", "MG", [("mass", 1500)]), ("10 IU/ML", None, [None]), ("500MG/L", None, [("mass_per_ml", 500)]), ("2 g/100 mL", None, [("mass_per_ml", 20_000)]),
]


@pytest.mark.parametrize(("strength", "unit", "want"), CASES)
def test_quantities(strength, unit, want):
    got = [None if u is None or u[0] == "unknown" else (u[0], rounded(n * u[1])) for n, u in quantities(strength, unit)]
    assert got == want


def test_numbers():
    assert [number(x) for x in ("1,000", "1,5", "1,000.5", ".5", "12,345,678")] == [1000, Fraction(3, 2), Fraction(2001, 2), Fraction(1, 2), 12_345_678]


def cost(x, starts):
    bounds = [*starts, len(x)]
    return sum(float(((x[a:b] - x[a:b].mean()) ** 2).sum()) for a, b in zip(bounds, bounds[1:])) + PENALTY * (len(starts) - 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.3, 3.0, 3.01, -2.0]), min_size=1, max_size=9))
def test_changepoints_are_optimal(values):
    x = np.array(values)
    every = (tuple([0, *c]) for k in range(len(x)) for c in itertools.combinations(range(1, len(x)), k))
    assert cost(x, segment(x)) == pytest.approx(min(cost(x, s) for s in every), abs=1e-9)


def test_long_history_and_empty():
    x = np.repeat([0.0, 3.0, 0.0], 400)
    assert segment(list(x)) == [0, 400, 800]
    assert segment([]) == []


OBS = "row_id long, history long, at long, strength string, unit string"


def test_history_gives_missing_units(spark):
    rows = [(1, 7, 1, "0.3", "G"), (2, 7, 2, "300", None), (3, 7, 3, "300", "MG"), (4, 8, 1, "5", None), (5, 9, 1, "40", "MG"), (6, 9, 2, "55", None), (7, 9, 3, None, "MG"), (8, 9, 4, "7", "CFU")]
    got = {r.row_id: r for r in convert_quantities(parse_quantities([("t", spark.createDataFrame(rows, OBS))])).collect()}
    assert (got[2].unit_source, got[2].amount) == ("segment", 300_000)
    assert got[1].amount == got[3].amount == 300_000
    assert got[4].unit_source == "none" and got[6].unit_source == "none" and got[8].unit_source == "unknown" and 7 not in got
    assert convert_quantities(parse_quantities([("t", spark.createDataFrame([], OBS))])).count() == 0


def told(units, df):
    return {(r.row_id, r.position_no): (r.unit_source, r.amount, r.segment_no, round(r.level_shift, 6)) for r in units.convert_quantities(units.parse_quantities([("t", df)])).collect()}


PLANTED = """id row_id, CASE WHEN id < 4000 THEN 1L WHEN id < 4200 THEN 2L WHEN id < 9000 THEN id DIV 6 END history, id at,
    CASE WHEN id < 4000 THEN IF(id % 1000 < 500, '500', '0.5') WHEN id < 4200 THEN IF(id < 4150, '20/5', '0.02/0.005') WHEN id % 6 < 3 THEN '300' WHEN id % 6 = 4 THEN '0' ELSE '0.3' END strength,
    CASE WHEN id % 97 = 3 THEN NULL WHEN id % 89 = 5 AND id < 4000 THEN 'MCG' WHEN id < 4000 THEN IF(id % 1000 < 500, 'MG', 'G') WHEN id < 4200 THEN IF(id < 4150, 'MG', 'G') WHEN id % 6 = 5 THEN NULL WHEN id % 6 < 3 THEN 'MG' ELSE 'G' END unit"""


def test_wrong_and_missing_units_follow_from_their_segments(spark):
    import rxloom.operators.units as units

    spark.range(9003).createOrReplaceTempView("ids")
    df = spark.sql(f"SELECT {PLANTED} FROM ids")
    got = told(units, df)
    assert len(got) == 9003 + 200
    assert {got[i, 1][1] for i in range(4000)} == {500_000} and {got[i, 1][1] for i in range(4000, 4200)} == {20_000} and {got[i, 2][1] for i in range(4000, 4200)} == {5_000}
    assert {got[i, 1][1] for i in range(4200, 8996) if i % 6 != 4 and i // 6 != 700} == {300_000}
    wrong = [i for i in range(4000) if i % 89 == 5]
    missing = [i for i in range(9000) if i % 97 == 3 and i % 6 != 4]
    assert all(got[i, 1][0] == "segment" for i in wrong + missing) and got[3999, 1][2:] == (8, round(-3.0, 6)) and got[9001, 1][0] == "written"


def test_ranges_and_room_change_nothing(spark, monkeypatch):
    import rxloom.operators.units as units

    spark.range(9003).createOrReplaceTempView("ids")
    df = spark.sql(f"SELECT {PLANTED} FROM ids")
    want = told(units, df)
    monkeypatch.setattr(units, "HELD", 150)
    assert told(units, df) == want
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert told(units, df) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_without_the_search_amounts_are_wrong(spark, monkeypatch):
    import rxloom.operators.units as units

    rows = [(i, 1, i, "500" if i < 6 else "0.5", "MG" if i < 6 else "G") for i in range(8)]
    df = spark.createDataFrame(rows, OBS)
    assert {x[1] for x in told(units, df).values()} == {500_000}
    monkeypatch.setattr(units, "segment", lambda x, w=None, p=0: [0])
    found = units.solve(((500.0, 6, ((("mass", 1000.0), 6),)), (0.5, 2, ((("mass", 1e6), 2),))))
    assert found[1][2] == {"mass": 1000.0}


def test_a_change_of_amount_stays(spark):
    import rxloom.operators.units as units

    rows = [(i, 1, i, "5" if i < 4 else "40", "MG") for i in range(8)]
    assert {x[1] for x in told(units, spark.createDataFrame(rows, OBS)).values()} == {5000, 40_000}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0.0, 0.3, 0.31, 3.0]), st.integers(1, 4)), min_size=1, max_size=6))
def test_runs_are_as_good_as_their_observations(runs):
    whole = [v for v, w in runs for _ in range(w)]
    starts = segment([v for v, _ in runs], [w for _, w in runs])
    at = np.concatenate(([0], np.cumsum([w for _, w in runs])))
    assert cost(np.array(whole), [int(at[s]) for s in starts]) == pytest.approx(cost(np.array(whole), segment(whole)), abs=1e-9)

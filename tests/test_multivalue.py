import pytest

from rxloom.functions.peg import LISTED, SUBSTANCES, parse
from rxloom.operators.multivalue import split_values

LISTS = [
    ('povidone, purified water, "silica, hydrated", and xanthan gum', ["povidone", "purified water", "silica, hydrated", "xanthan gum"]),
    ("starch, pregelatinized; talc; castor oil, hydrogenated.", ["starch, pregelatinized", "talc", "castor oil, hydrogenated"]),
    ("• a b\n• c (d, e)\n- f", ["a b", "c (d, e)", "f"]),
    ("• a • b", ["a", "b"]),
    ("Core tablets: a, b; Coating: c, d and e", ["a", "b", "c", "d", "e"]),
    ("Core tablets: a, b. Coating: c", ["a", "b", "c"]),
    ("mono- and diglycerides", ["mono- and diglycerides"]),
    ("hydrochloric acid and/or sodium hydroxide and talc", ["hydrochloric acid and/or sodium hydroxide", "talc"]),
    ('"natural flavour ""wild mint""";b', ['natural flavour "wild mint"', "b"]),
    ('natural flavour "wild mint", b', ['natural flavour "wild mint"', "b"]),
    ("a\tb\tc", ["a", "b", "c"]), ("a | b", ["a", "b"]), ("x / y and/or z", ["x", "y and/or z"]), ("D&C Yellow No. 10 ; b", ["D&C Yellow No. 10", "b"]),
    ("a, b;", ["a", "b"]), ("Not in PM", []), ("needs OCR / manual check", []), ("", []), ("  ", []), (None, []),
]


@pytest.mark.parametrize(("text", "want"), LISTS)
def test_listed(text, want):
    assert [v for _, v, _ in parse(text, LISTED)] == want


def test_substances_and_flags():
    assert [v for _, v, _ in parse('A (A SODIUM); "B" + C with D', SUBSTANCES)] == ["A (A SODIUM)", "B", "C", "D"]
    assert parse('A "B; C', SUBSTANCES) == [(1, 'A "B', "open_quote"), (2, "C", "")]
    assert parse("A (B; C", SUBSTANCES) == [(1, "A (B", "open_bracket"), (2, "C", "")]
    assert [x[2] for x in parse('"A" B; C', SUBSTANCES)] == ["text_after_quote", ""]
    long = ";".join(f"v{i}" for i in range(20_000)) + ';"' + "(" * 2000
    assert len(parse(long, SUBSTANCES)) == 20_001


def test_rows(spark):
    df = spark.createDataFrame([(1, "a; b", "x"), (2, "a", "x"), (3, None, None), (4, "a; b", "x"), (5, "N/A", "x")], "row_id long, t string, flag string")
    got = split_values([("s", df, "row_id", "t", "substances")]).collect()
    assert sorted((r.row_id, r.position_no, r.item_value) for r in got) == [(1, 1, "A"), (1, 2, "B"), (4, 1, "A"), (4, 2, "B")]
    assert split_values([("s", df.limit(0), "row_id", "t", "listed")]).count() == 0
    assert split_values([("s", df, "row_id", "t", "listed")], several_only=False).where("row_id = 2").count() == 1


def test_a_bracket_closes_after_one_that_does_not(spark):
    assert parse("A (B, C (D, E), F", SUBSTANCES) == [(1, "A (B", "open_bracket"), (2, "C (D, E)", ""), (3, "F", "")]
    assert parse("A (B [C, D), E", SUBSTANCES) == [(1, "A (B [C, D)", ""), (2, "E", "")]
    assert parse("A (B; C (D; E", SUBSTANCES) == [(1, "A (B", "open_bracket"), (2, "C (D", "open_bracket"), (3, "E", "")]
    deep = "([" * 20_000 + ";" + "(a;b)"
    assert [v for _, v, _ in parse(deep, SUBSTANCES)][1:] == ["(a;b)"]
    df = spark.createDataFrame([(1, "Core: lactose. Coating: talc")], "row_id long, t string")
    assert [r.item_value for r in split_values([("s", df, "row_id", "t", "listed")]).collect()] == ["LACTOSE", "TALC"]


@pytest.mark.parametrize(("a", "z"), [("(", ")"), ("[", "]"), ("{", "}")])
def test_unbalanced_nests_of_every_bracket(a, z):
    got = parse(f"X {a}Y {a}A, B{z}, C", SUBSTANCES)
    assert got == [(1, f"X {a}Y {a}A, B{z}", "open_bracket"), (2, "C", "")]
    assert [v for _, v, _ in parse(f"X {a}Y ({a}A, B{z}){z}, C{z}, D", SUBSTANCES)] == [f"X {a}Y ({a}A, B{z}){z}", f"C{z}", "D"]

import pytest

from rxloom.operators import label_fields as lf
from rxloom.operators.label_fields import NOT_IN_PM, PH_SOLUBILITY, Text, acidity, appearance, excipients, label, label_rows, merged_labels, nonmedicinal, packaging, plain_strength, preservatives, scanned

SIX = "6 DOSAGE FORMS, STRENGTHS, COMPOSITION AND PACKAGING"
PAGES = [
    (1, "Contents\n" + "\n".join(f"{i} Something ........ {i}" for i in range(1, 9)) + f"\n{SIX} ........ 6"),
    (6, f"see {SIX}.\n{SIX}\nActive Ingredient: alpelisib\nNon-medicinal Ingredients: hypromellose, magnesium stearate\nand mannitol\n\nDescription\n50 mg: light pink, round, film-coated tablet, 7.2 mm\nPackaging\nBlister packs of 28 tablets\n7.1.4 Geriatrics)."),
    (7, "7 mg / 5 mg tablets are white\n7 WARNINGS AND PRECAUTIONS\nyellow tablets"),
    (13, "13 PHARMACEUTICAL INFORMATION\npH 1.2: 2.1 mg/mL\npH 6.8: 0.1 mg/mL\n14 CLINICAL TRIALS\npH: 7.0"),
]


def test_label():
    got = label(PAGES)
    assert got["nonmedicinal_ingredients"] == ("hypromellose, magnesium stearate and mannitol", 6) and got["active_ingredient"] == ("alpelisib", 6)
    assert got["color"] == ("light pink", 6) and got["shape"] == ("round", 6) and got["size_mm"] == ("7.2 mm", 6) and got["weight"] == (NOT_IN_PM, None)
    assert got["ph"] == (PH_SOLUBILITY, None) and got["pack_style"] == ("Blister Pack", 6) and got["pack_size"] == ("28 count", 6)
    assert got["preservatives"] == ("N", 6) and got["excipients_coating"][0] == lf.UNCOATED
    assert label([(1, None)])["color"] == (NOT_IN_PM, None) and label([])["ph"] == (NOT_IN_PM, None)


def test_fallbacks():
    assert label([(1, "x"), (2, "PART III: CONSUMER INFORMATION\nXOLEGEL comes in amber.\nThe skin may appear red.")])["color"] == ("amber", 2)
    got = label([(1, f"intro\n{SIX}\nnothing of note\n7 WARNINGS"), (4, "AVAILABILITY OF DOSAGE FORMS\nEach oval tablet is white to slightly grey.\nTOXICOLOGY\nblue tablets")])
    assert got["color"] == ("white to slightly grey", 4) and got["shape"] == ("oval", 4)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Non-medicinal ingredients:\ntalc\nPackaging", "talc"), ("contains the following non-medicinal excipients: starch, talc.\n\nx", "starch, talc."), ("Composition: TEVA-X contains: starch", "starch"),
        ("The other ingredients are: talc and starch", "talc and starch"), ("Nonmedicinal Ingredients\nlactose - 11 - PART II: SCIENCE", "lactose"), ("What the nonmedicinal ingredients are: talc", None),
        ("Non-medicinal ingredients: talc. Keep this leaflet", None), ("Each gram of cream contains: wax", "wax"), ("Non-medicinal Ingredients\nAdministration\nStrength", None),
    ],
)
def test_nonmedicinal(text, want):
    assert nonmedicinal(text) == want


def test_small_parts():
    assert [plain_strength(x) for x in ("50.0 MG", "2.50mg", "x", None, "10")] == ["50 MG", "2.5 mg", "x", None, "10"]
    assert acidity("pH: 5.5-7.0\n") == "5.5-7.0" and acidity("pH: 67\n") == NOT_IN_PM and acidity("") == NOT_IN_PM
    assert preservatives("Preservative: none") == "N" and preservatives("Preservatives: benzyl alcohol") == "Y" and preservatives("nothing") == NOT_IN_PM
    assert preservatives("Inactive ingredients: water, methylparaben and sorbitol solution") == "Y"
    assert excipients("Core Ingredients: talc, starch\nFilm Coating: wax\n\n") == ("talc, starch", "wax") and excipients("Inactive ingredients: debossed tablets") == (None, None)
    assert scanned([(1, "a" * 10), (2, None)]) and not scanned([(1, "a" * 99)])
    assert appearance("white powder in each vial") == {} and appearance("yellow jaundice") == {}
    assert appearance("• 50 mg: pink tablet\n• 150 mg: red ovaloid tablet", "150.0 mg") == {"color": "red", "shape": "ovaloid"}
    assert appearance("Tablet weight: 350 mg, each 8 mm x 4 mm") == {"size_mm": "8 mm x 4 mm", "weight": "350 mg"}
    assert packaging("Tablets are supplied in bottles of 100 and\n500 tablets. Also blister cards of 10 tablets. Store at 15 in bottles of 3.") == ("in bottles of 100 and 500 tablets.; Also blister cards of 10 tablets.", "Bottle; Blister")
    assert packaging("Patients got 3 vials.") == (None, None) and packaging("Packaging:\n") == (None, None)
    assert Text([(1, "A"), (2, "b")]).part(lf.pattern("^zz"), None).page is None


def test_provider():
    class One(lf.NoProvider):
        def fields(self, text, page, group):
            return {"color": {"value": "teal", "found": True, "page": 3}, "shape": {"found": False}} if group == "appearance" else {"ph": {"value": " 5 ", "found": True}}

    got = label(PAGES, provider=One())
    assert got["color"] == ("teal", 3) and got["shape"] == (NOT_IN_PM, None) and got["ph"] == ("5", 13)


def test_rows(spark):
    rows = [(i, 1, p, t) for i, (p, t) in enumerate(PAGES)] + [(9, 1, 6, "short"), (10, 2, 1, None), (11, None, 3, "Each oval tablet is blue, so much text that it needs no recognition at all.")]
    df = spark.createDataFrame(rows, "page_id long, monograph_id long, page int, text string").repartition(3)
    got = {r.monograph_id: r for r in label_rows(df).collect()}
    assert got[1].color == "light pink" and got[1].color_page == 6 and got[2].needs_ocr == 1 and got[1].needs_ocr == 0 and got[None].color == "blue"
    assert label_rows(df.limit(0)).count() == 0


def test_stages(spark):
    wanted = spark.createDataFrame([("1", 10), ("2", 10), ("3", 11), ("4", 12), ("5", 13)], "din string, drug_code int")
    cat = spark.createDataFrame([(10, True, "u1", "ABC", None, " "), (11, False, "u1", "X", "1", "Vial"), (12, True, None, "N", None, None), (13, True, "u2", "Q", None, None)], "drug_code int, ok boolean, pdf_url string, active_ingredient string, pack_size string, pack_style string")
    doc = spark.createDataFrame([("u1", True, "abc", "28 count", "Bottle", "white"), ("u2", False, "q", "1", "Jar", "red")], "pdf_url string, ok boolean, active_ingredient string, pack_size string, pack_style string, color string")
    got = {r.din: r for r in merged_labels(wanted, cat, doc).collect()}
    assert set(got) == {"1", "2", "4"} and (got["1"].active_ingredient, got["1"].pack_size, got["1"].pack_style, got["1"].color) == ("ABC", "28 count", "Bottle", "white") and got["4"].color == "No PM available"

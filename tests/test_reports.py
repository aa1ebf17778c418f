import itertools
from difflib import get_close_matches

import pytest

from pyspark.sql import functions as F
from rxloom.functions import names as N
from rxloom.operators import audit, grader, register, reports
from rxloom.operators.findings import findings
from rxloom.operators.matcher import Candidates, component_words, match_sales


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7919 % 101, i) for i in range(101)], "k int, id int")
    got = {r.k: r.position for r in reports.numbered(df, [F.col("k")], first=2).collect()}
    assert got == {k: k + 2 for k in range(101)} and reports.numbered(df.limit(0), [F.col("k")]).count() == 0


def test_stamps_and_outcomes(spark):
    sheet = spark.createDataFrame([("1", 1, 9), ("1", 2, 9), ("2", 3, 9), (None, 4, 9)], "din string, row int, dollars int")
    found = spark.createDataFrame([("1", 5), ("1", 6), ("3", 1)], "din string, dollars int")
    assert [(r.din, r.dollars) for r in reports.stamped(sheet, found, "din", [F.col("row")], ["dollars"]).orderBy("row").collect()] == [("1", 11), ("1", None), ("2", None), (None, None)]
    recon = spark.createDataFrame([("1", "low_score", 60.0, 1), ("1", "matched", 90.0, 2), ("1", "matched", 99.99, 3), ("2", "not_sold", None, 4), (" ", "ambiguous", 0.0, 5), ("4", "low_score", 58.0, 6)], "din string, status string, top_score double, i int")
    best = {r.din: (r.status, r.confidence) for r in reports.best_outcomes(recon, [F.col("i")]).collect()}
    assert best == {"1": ("matched", "high"), "2": ("not_sold", "none"), "4": ("low_score", "low")}
    assert {(r.row, r.match_confidence) for r in reports.with_confidence(sheet, recon, [F.col("i")]).collect()} == {(1, "high"), (2, "high"), (3, "none"), (4, "none")}


def test_orders(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("a", "y", 1.0), ("b", "x", 9.0), ("c", "z", 6.0)], "g string, k string, d double")
    assert [(r.g, r.k) for r in reports.signal_order(df, ["g"], "d").collect()] == [("b", "x"), ("a", "x"), ("a", "y"), ("c", "z")]
    assert [r.g for r in reports.group_order(df.groupBy("g").count(), "C ", "g", "count").collect()] == ["c", "a", "b"]
    moves = spark.createDataFrame([("a", 1.0, 2.0), ("b", 9.0, 1.0), ("c", 2.0, 1.0)], "k string, o double, n double")
    assert [r.k for r in reports.move_order(moves, "o", "n", ["k"]).collect()] == ["b", "a", "c"]
    found = spark.createDataFrame([("1", 3.0, "low"), ("2", 1.0, "high"), ("3", 2.0, "high"), ("4", 0.0, "none")], "din string, suspicion double, tier string")
    assert [r.din for r in reports.suspicious_order(found).collect()] == ["3", "2", "1"]
    assert [(r.k, r.row_no, r.shaded) for r in reports.striped(df.where("g = 'a'"), "g", [F.col("k")]).orderBy("k").collect()] == [("x", 1, False), ("y", 2, True)]


def test_rates(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (None, False)], "p boolean, a boolean")
    r = reports.confusion(df, F.col("p"), F.col("a")).first()
    assert tuple(r)[:4] == (1, 1, 1, 1) and (r.precision, r.recall) == (0.5, 0.5)
    assert reports.confusion(df.limit(0), F.col("p"), F.col("a")).first().recall is None
    e = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    assert tuple(reports.completeness(e, e.where("k = '1'"), "k").first()) == (2, 1, 0.5) and reports.completeness(e.limit(0), e, "k").first().missed_rate == 0.0
    calls = spark.createDataFrame([("f", "2024-01-01 00:00:00", 10.0), ("f", "2024-01-01 00:00:05", 5.0), ("f", "2024-01-01 00:00:10", 1.0)], "name string, at string, s double")
    assert tuple(reports.profile(calls, "name", F.to_timestamp("at"), F.col("s")).first()) == ("f", 3, 16.0, 5.333, 10.0, 2)
    once = reports.once_per_value(spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "i int, c string"), "c", "u", lambda c: F.upper(c))
    assert {(r.i, r.c if "c" in r else None, r.u) for r in once.collect()} == {(1, "a", "A"), (2, None, None), (3, "a", "A")}


def test_patches_and_filings(spark):
    sheet = spark.createDataFrame([("1", "b", None), ("2", "c", "old")], "din string, brand string, color string")
    labels = spark.createDataFrame([("1", "red"), ("2", "blue")], "din string, color string")
    assert {(r.din, r.color) for r in reports.patched(sheet, labels, spark.createDataFrame([("1",), ("9",)], "din string"), ["color"]).collect()} == {("1", "red"), ("2", "old")}
    p = spark.createDataFrame([("METFORMIN HYDROCHLORIDE",), ("SITAGLIPTIN METFORMIN",), ("NONE",)], "names string")
    f = spark.createDataFrame([("metformin",), ("Metformin HCl",), ("metformin and sitagliptin",), ("hcl",), (None,)], "i string")
    got = {r.names: r.filings for r in reports.filings_of(p, f, N.molecule_tokens(F.col("names")), N.molecule_tokens(F.col("i"))).collect()}
    assert got == {"METFORMIN HYDROCHLORIDE": 2, "SITAGLIPTIN METFORMIN": 0, "NONE": 0}


def test_register_against_brute_force(spark):
    products = [(i, c) for i in ("Alpelisib 50 mg", "clesrovimab (x)", "met", "", None, "alpelisib") for c in ("Novartis Pharmaceuticals Canada Inc.", "Merck Canada", "Mercks", "", None)]
    entries = [(0, "alpelisib", "Novartis"), (1, "clesrovimab", "Merck Canada Inc"), (2, "metformin", "Merck"), (3, "metformin", "merck ltd."), (4, "alpelisib tartrate", "Novartiss"), (5, " ", "Merck")]
    p = spark.createDataFrame(products, "ingredient string, company string")
    r = spark.createDataFrame(entries, "entry_no int, medicinal_ingredient string, manufacturer string")
    got = {(x.ingredient_key, x.company_key): (x.entry_no, x.how) for x in register.register_entries(p, r).collect()}
    norm = {x.v: (x.i, x.m) for x in spark.createDataFrame([(v,) for v in {*itertools.chain(*products), *itertools.chain(*(e[1:] for e in entries))}], "v string").select("v", N.register_ingredient(F.col("v")).alias("i"), N.register_manufacturer(F.col("v")).alias("m")).collect()}
    want = {}
    for i, c in products:
        ik, ck = norm[i][0], norm[c][1]
        short = [(n, norm[m][1]) for n, ing, m in entries if norm[ing][0] and (ik in norm[ing][0] or norm[ing][0] in ik)] if ik else []
        exact = [n for n, m in short if m == ck]
        if len(exact) == 1:
            want[ik, ck] = (exact[0], "exact")
        elif not exact and ck and (near := get_close_matches(ck, sorted({m for _, m in short}), n=1, cutoff=0.8)):
            want[ik, ck] = (min(n for n, m in short if m == near[0]), "near")
    assert got == want and {h for _, h in want.values()} == {"exact", "near"}


LABEL = "row_id int, nonmedicinal_ingredients string, pack_style string, pack_size string, size_mm string, ph string, color string, shape string, preservatives string"


def test_label_grades(spark):
    rows = [
        (1, "talc; Tablets with 'X' debossed", "Bottle:", "30 per bottle", "10 x 4", "15", "white/zzz", "round", "Maybe"), (2, "Core:", "Dosage strengths", "100 count", "31 mm", "5.5-7.0", "off-white, pale red", "blob", "Y"),
        (3, "Not in PM", None, "N/A", "8 × 4 mm", "Not stated (pH-dependent solubility only)", "No PM available", "capsule-shaped", None), (4, None, "pen", "penicillin 5", "8-9 mm", "3", "", None, "N"),
    ]
    df = spark.createDataFrame(rows, LABEL)
    checks = [*grader.excipient_checks("nonmedicinal_ingredients"), *grader.pack_checks(), *grader.descriptor_checks(preservatives=True)]
    got = {(r.row_id, r.check_id) for r in findings(df, "row_id", checks).collect()}
    assert got == {
        (1, "excipient_poison"), (1, "style_colon"), (1, "size_container"), (1, "size_format"), (1, "ph_range"), (1, "color_vocabulary"), (1, "preservatives_value"),
        (2, "excipient_heading"), (2, "style_heading"), (2, "style_vocabulary"), (2, "size_range"), (2, "shape_vocabulary"),
    }
    assert grader.stages(df) == {"LABELING": True, "PATENTS": False, "NOC": False, "DP": False}
    assert grader.grade(df.where("row_id = 3").select("row_id", F.lit(None).cast("string").alias("ph")), "row_id", {"LABELING": [("x", "ph", "ERROR", F.lit(True))], "": [("y", "ph", "ERROR", F.lit(True))]}).collect()[0].check_id == "y"
    assert grader.column_findings(["a_url", "b", "c_page"]) == [("column_url", "a_url", "ERROR"), ("column_page", "c_page", "ERROR")]


def test_joined_grades(spark):
    mart = spark.createDataFrame([(1, 7, "A; B", "100 count", "Bottle", "talc, hydroxypropylmethylcelIulqse", 1), (2, 7, "a", "30.5 mL", "Vial", "wax; magnesium stearate", 0), (3, 8, "Z", "1", "Jar", "talc", 0)], "row_id int, drug_code int, active_ingredient string, pack_size string, pack_style string, excipients string, needs_ocr int")
    live = spark.createDataFrame([(7, " a "), (7, None), (9, "Z")], "drug_code int, ingredient_name string")
    assert [(r.row_id, r.value) for r in grader.invented_values(mart, live, "row_id", "active_ingredient", "drug_code", "ingredient_name").collect()] == [(1, "B")]
    info = spark.createDataFrame([(7, "Bottles of 100"), (7, "30 mL"), (8, None)], "drug_code int, product_information string")
    assert {(r.row_id, r.check_id, r.value) for r in grader.invented_pack(mart, info, "row_id", "drug_code").collect()} == {(3, "size_invented", "1"), (3, "style_invented", "Jar")}
    pages = spark.createDataFrame([(7, "Hydroxypropylmethylcellulose, talc and magnesium stearate"), (7, None)], "drug_code int, text string")
    got = {(r.row_id, r.check_id, r.value) for r in grader.fabricated_excipients(mart, pages, "row_id", "excipients", "drug_code").collect()}
    assert got == {(1, "excipient_nearly", "hydroxypropylmethylcelIulqse"), (2, "excipient_fabricated", "wax")}
    a = spark.createDataFrame([(1, "CA 1,234,567"), (2, "7654321"), (3, None)], "row_id int, patent_number string")
    b = spark.createDataFrame([("1234567", "2001-01-01"), ("7654321", " ")], "patent_number string, filing_date string")
    assert [r.row_id for r in grader.ghost_patents(a, b, "row_id").collect()] == [2]
    assert grader.rerun_differences(lambda: a).count() == 0
    text = grader.report(grader.ghost_patents(a, b, "row_id"))
    assert "| ERROR | ghost_patent | 1 |" in text


def test_candidates_share_a_word_of_every_molecule(spark):
    words = lambda t, sep: [list(w) for w in spark.createDataFrame([(t,)], "t string").select(component_words(F.col("t"), sep).alias("w")).first().w]
    assert words("TELMISARTAN/HCTZ", "[:/;+]") == [["TELMISARTAN"], ["HCTZ"]] and words(None, ";") == [] and words("A; ;BCDE FGHI", ";") == [[], ["BCDE", "FGHI"]]
    c = Candidates([[["TELMISARTAN"], ["HYDROCHLOROTHIAZIDE", "HCTZ"]], [["VALSARTAN"], ["HCTZ"]], [[], ["HCTZ"]]])
    assert c.of([["TELMISARTAN"], ["HCTZ"]]) == [0] and c.of([[], ["HCTZ"]]) == [0, 1, 2] and c.of([["NONE"], []]) == []
    sold = spark.createDataFrame([("SODIUM VALPROATE", "EPIVAL", "ABBOTT", "5MG")], "combined_molecule string, product string, manufacturer string, strength string")
    products = spark.createDataFrame([("1", "VALPROIC ACID SODIUM", "EPIVAL", "ABBOTT LTD", "5 MG", "marketed"), ("2", "OTHER SALT", "EPIVAL", "ABBOTT", "5 MG", "marketed")], "din string, ingredient string, brand_name string, company string, strength string, status string")
    assert match_sales(sold, products).where("status = 'matched'").first().din == "1"


def test_values_of_products_are_groups_or_sums(spark):
    sold = spark.createDataFrame([("M", "PMS-M", "PMS", "10MG", 5, 7), ("M", "M", "PMS", "10MG", 2, 1), ("M", "APO-M", "APOTEX", "10MG", 5, 7), ("M", "X", "ZZZ", "5MG", 1, 1)], "combined_molecule string, product string, manufacturer string, strength string, dollars long, units long")
    p = spark.createDataFrame([("1", "PMS-M", "PMS INC", "10 MG", 7, 8), ("2", "APO-M", "APOTEX", "10 MG", 5, 7), ("3", "Q", "QQQ", "10 MG", 9, 9), ("4", "R", "R", "1 MG", None, None)], "din string, brand_name string, company string, strength string, dollars long, units long")
    got = {r.din: (r.kind, r.product, r.groups) for r in audit.audit_values(p, sold, ["dollars", "units"]).collect()}
    assert got == {"1": ("sum", "PMS-M", 2), "2": ("group", "APO-M", 1), "3": ("orphan", None, 0)}
    assert audit.audit_values(p.limit(0), sold, ["dollars", "units"]).count() == 0


@pytest.mark.parametrize(("text", "want"), [("x 2025-1-9 y 2024-01-01", "2025-01-09"), ("2024-99-99", None), ("none", None), (None, None)])
def test_first_date(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(N.first_iso_date(F.col("t")).alias("d")).first().d
    assert (got and got.isoformat()) == want


def test_suspicious_order_once(spark):
    """The order samples its input first; the audit is not made anew for that."""
    made = spark.sparkContext.accumulator(0)

    def audited(batches):
        for b in batches:
            made.add(len(b))
            yield b

    schema = "din string, suspicion double, tier string"
    rows = [(f"{i:03d}", float(i % 7), "high" if i % 2 else "low") for i in range(200)]
    found = spark.createDataFrame(rows, schema).repartition(4).mapInPandas(audited, schema)
    got = [(r.tier != "high", -r.suspicion, r.din) for r in reports.suspicious_order(found).collect()]
    assert got == sorted(got) and len(got) == sum(r[1] > 0 for r in rows)
    assert made.value == 200

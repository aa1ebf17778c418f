import csv
import datetime as dt
import json
import zipfile

import pytest

from pyspark.sql import functions as F
from rxloom import api
from rxloom.functions import requests as rq
from rxloom.functions import xlsx
from rxloom.sinks import reports as sinks
from rxloom.sources import pages as pg

REGISTER = """<h2>Other drugs</h2><table><tr><th>x</th></tr><tr><td>y</td></tr></table><h2>Register of active innovative drugs</h2><table>
<tr><th>Medicinal Ingredient(s)</th><th>Submission Number</th><th>Innovative Drug</th><th>Manufacturer</th><th>Drugs containing</th><th>Notice of Compliance date</th><th>6 Year No File Date</th><th>Pediatric Extension</th><th>Data Protection Ends</th></tr>
<tr><td>clesrovimab</td><td>1</td><td>E</td><td>Merck Canada</td><td></td><td>2026-01-30</td><td>2032-01-30</td><td>Yes</td><td>2034-07-30</td></tr><tr><td> </td><td>2</td></tr></table>"""


def test_pages(spark):
    html = "<select id='medicinalIngredient'><option>metformin<option> a  b </option></select><select name=brandName><option></option></select>"
    assert pg.select_options(html, "medicinalIngredient") == ["metformin", "a b"] and pg.select_options(html, "brandName") == [] and pg.select_options(None, "x") == []
    table = "<table><tr><th>1</th></tr><tr>" + "".join(f"<td>{c}</td>" for c in "abcdefg") + "</tr><tr><td>short</td></tr></table><table><tr>" + "<td>z</td>" * 7 + "</tr></table>"
    assert pg.register_patents(table) == [tuple("abcdefg")]
    filed = "<table><tbody><tr><td>met<br>formin</td><td>Not available</td><td>area</td><td>2024, January</td></tr></tbody></table>"
    rows = pg.filings(spark.createDataFrame([(1, filed), (2, filed), (3, None)], "id int, html string"), "id")
    assert [tuple(r)[2:] for r in rows.where("id = 1").collect()] == [("met, formin", None, "area", "2024, January")]
    assert pg.search_filings(rows, ["FORMIN", "zzz"]).count() == 1 and pg.search_filings(rows, ["zzz"]).count() == 0
    with pytest.raises(ValueError, match="unsupported"):
        pg.search_filings(rows, ["x"], "brand")
    (r,) = pg.register_table(REGISTER)
    assert (r["medicinal_ingredient"], r["manufacturer"], r["no_file_date"], r["pediatric_extension"], r["data_protection_ends"]) == ("clesrovimab", "Merck Canada", "2032-01-30", "Yes", "2034-07-30")
    assert pg.register_table("<p>none</p>") == [] and pg.register_table(None) == []
    res = spark.createDataFrame([("Metformin", 1, "i", "b", "d", "p"), ("Metformin", 2, "i", "b", "d", "p"), ("Other", 3, "o", "b", "d", "q")], "option string, row_no int, ingredient string, brand string, din string, patent_number string")
    assert [r.row_no for r in pg.search_patents("metformin", ["Metformin", "Other"], res).collect()] == [1]


def test_details():
    rows = "<table><tr><th>Filing Date</th><td>2008-12-10</td></tr><tr><td>Date Granted:</td><td>2014-08-26</td></tr></table>"
    assert pg.patent_detail(rows) == {"filing_date": "2008-12-10", "grant_date": "2014-08-26", "expiry_date": None}
    text = "<p>(22) Filed: 2007-03-23</p><p>(45) Issued: 2015-04-28</p><table><tr><td>2027-03-23</td><td>E1</td><td>Expired</td></tr></table>"
    assert pg.patent_detail(text) == {"filing_date": "2007-03-23", "grant_date": "2015-04-28", "expiry_date": "2027-03-23"}
    assert pg.full_detail({"filing_date": None}, {"filing_date": "2008-02-29", "grant_date": "x"})["expiry_date"] == "2028-02-29" and pg.full_detail({"filing_date": "1989-09-30"}, {})["expiry_date"] is None
    assert pg.product_page("<a href='/a.PDF?x=1'>m</a><p>Date of revision 2024-05-06</p>")["pdf_date"] == "2024-05-06" and pg.product_page("<a href='/a.PDF?x=1'>m</a>")["pdf_url"] == "/a.PDF?x=1"
    assert pg.product_page(" ")["ok"] is None and pg.product_page("<p>x</p>") == {"ok": "yes", "pdf_url": None, "pdf_date": None, "description": None}
    assert pg.is_fresh(10, 12, 2) and not pg.is_fresh(10, 13, 2) and not pg.is_fresh(None, 0, 9)


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("in/drug.txt", "x")
    with pytest.raises(ValueError, match=r"ingred\.txt"):
        pg.unpack_extract(str(tmp_path / "e.zip"), str(tmp_path))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        for m in pg.EXTRACT_MEMBERS:
            z.writestr(m, m)
    pg.unpack_extract(str(tmp_path / "e.zip"), str(tmp_path))
    assert (tmp_path / "comp.txt").read_text() == "comp.txt"
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("drugs_e.txt", "DRUG_ID,DIN\n1,123\n2,0\n")
        z.writestr("patent-service_e.txt", "DRUG_ID,PATENT_NUMBER,FILING_DATE,DATE_GRANTED,EXPIRATION_DATE\n1,27090253022097,1/2/2003,,\n1,CA 2709025,1/3/2003,a,b\n2,1111111,,,\n")
    drugs, patents = pg.patent_archive(spark, str(tmp_path / "p.zip"))
    assert {r.patent_number: r.filing_date for r in pg.patents_by_number(patents).collect()} == {"2709025": "1/3/2003", "3022097": "1/2/2003", "1111111": ""}
    assert [tuple(r) for r in pg.patents_of_dins(drugs, patents).collect()] == [("00000123", ["2709025", "3022097"])]


def test_workbooks(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    xlsx.write(path, {"Pivot": (["a"], []), "Rows & <more>": (["Dollars MAT 2024/06", "Name"], [(1, "x\x01y"), (None, "é <&>"), (2.5, float("nan"))])})
    assert list(xlsx.sheets(path)) == ["Pivot", "Rows & <more>"] and pg.data_sheet(path) == "Rows & <more>" and pg.workbook_kind(path) == "xlsx"
    assert [tuple(r) for r in pg.workbook_table(spark, path).collect()] == [(2, "1", "xy"), (3, None, "é <&>"), (4, "2.5", None)]
    assert [xlsx.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and all(xlsx.column_number(xlsx.column_name(i)) == i for i in range(900))
    xlsx.write(path, {"data": (["note"], [("DIN", "Brand"), ("1", "B")]), "big": (["Units MAT 2024/06"] * 3, [])})
    assert pg.data_sheet(path) == "data" and [tuple(r) for r in pg.workbook_table(spark, path, header_within=3, marker="din").collect()] == [(3, "1", "B")]
    (tmp_path / "c.csv").write_text("a")
    (tmp_path / "o.xls").write_bytes(bytes.fromhex("d0cf11e0a1b11ae1"))
    assert pg.workbook_kind(str(tmp_path / "c.csv")) == "csv" and pg.workbook_kind(str(tmp_path / "o.xls")) == "xls"


def test_json_records(spark, tmp_path):
    def put(kind, name, what):
        (tmp_path / kind).mkdir(exist_ok=True)
        (tmp_path / kind / name).write_text(json.dumps(what))

    put("product", "1.json", {"drug_code": 1, "brand_name": "B"})
    put("activeingredient", "1.json", [{"drug_code": 1, "ingredient_name": "b", "strength": "5", "strength_unit": "MG"}, {"drug_code": 1, "ingredient_name": "A"}])
    put("form", "1.json", [{"drug_code": 1, "pharmaceutical_form_name": "TABLET"}])
    put("route", "1.json", [])
    put("status", "1.json", {"drug_code": 1, "status": "MARKETED"})
    put("schedule", "1.json", [{"drug_code": 2, "schedule_name": "X"}])
    (r,) = pg.catalogue_records(spark, str(tmp_path)).collect()
    assert (r.brand_name, r.ingredient, r.form, r.route, r.status, r.schedule) == ("B", "A; b", "TABLET", None, "MARKETED", None)


def test_requests(spark):
    assert rq.queries("a, B ,a\n") == ["a, B ,a"] and rq.queries("a, B ,A,,") == ["a", "B"] and rq.queries(["x", None, " X "]) == ["x"]
    day = dt.date(2025, 1, 1)
    assert rq.future_date("01/02/2025", day) == dt.date(2025, 1, 2)
    for bad in ("01/01/2025", "1/2/2025", "13/01/2026", "2026-01-01"):
        with pytest.raises(ValueError):
            rq.future_date(bad, day)
    assert rq.period_label((2024, 6)) == "2024/06" and rq.period_label(None) == "—" and rq.period_tag((2024, 6)) == "2024-06" and rq.period_tag(None) == "NA"
    assert rq.ordered_periods((2025, 1), (2024, 1)) == (True, []) and rq.ordered_periods((2024, 1), (2024, 1))[1]
    with pytest.raises(ValueError):
        rq.ordered_periods(None, (2024, 1))
    assert rq.header("din") == "DIN" and rq.header("pack_size") == "Pack Size" and rq.stage_share("Patents", 1, 2) == 0.35 and rq.stage_share("Workbook", 0, 0) == 1.0
    assert rq.seconds_left(0, 9, 1) is None and rq.seconds_left(2, 6, 4) == 8
    t = spark.createDataFrame([("Metformin",), (None,), ("zzz",)], "term string")
    s = spark.createDataFrame([("metformin", "Glucophage"), ("other", "x"), ("metformin", None)], "term string, synonym string")
    assert {tuple(r) for r in rq.expanded(t, s).collect()} == {("metformin", "metformin"), ("metformin", "glucophage"), ("zzz", "zzz")}


def test_sinks_and_api(spark, sf, tmp_path):
    b = api.Bundle(spark, sf)
    assert b.get("api_main") is b.get("api_main") and b.is_fresh(b.built_at) and not b.is_fresh(b.built_at + dt.timedelta(hours=5))
    names = [r[0] for r in b.get("activeingredient").where("length(ingredient_name) > 4").select("ingredient_name").limit(2).collect()]
    found = api.search(b, names[0][:5], synonyms={names[0][:5].lower(): [names[1][:5]]})
    assert found["catalogue"].count() >= 0 and found["approvals"].columns[0] == "noc_number"
    with pytest.raises(ValueError):
        api.search(b, " , ")
    api.export(b, str(tmp_path / "m.xlsx"))
    assert list(xlsx.sheets(str(tmp_path / "m.xlsx"))) == ["Products", "Filings"]
    api.exclusions(b, str(tmp_path / "x.csv"))
    assert next(csv.reader(open(tmp_path / "x.csv"))) == ["DIN", "Company Name", "Reason"]
    b.reset()
    assert not b.kept
    a = spark.createDataFrame([("1", "x", 5), ("2", "y", 6)], "din string, note string, n int")
    both = sinks.stacked_mart({"p": a, "q": a.drop("n")}, ["din", "n"])
    assert both.columns == ["ingredient_name", "din", "n", "note"] and both.count() == 4
    sinks.filtered_workbook(str(tmp_path / "f.xlsx"), a, a, a.where("n = 6"))
    assert len(list(xlsx.rows(str(tmp_path / "f.xlsx"), xlsx.sheets(str(tmp_path / "f.xlsx"))["Detail"]))) == 2
    folder = sinks.deliver({"t": a}, str(tmp_path / "lake"), "mart", dt.datetime(2025, 1, 2, 3, 4, 5))
    assert folder.endswith("mart_20250102_030405") and spark.read.parquet(folder + "/t").count() == 2
    sinks.findings_report(str(tmp_path / "r.md"), a.select("din", F.lit("c").alias("check_id"), F.lit("WARN").alias("severity"), F.lit("a|b").alias("value")))
    assert "| WARN | c | 2 |" in (tmp_path / "r.md").read_text() and len(list(csv.reader(open(tmp_path / "r.csv")))) == 3
    recon = spark.createDataFrame([("matched", "m", "p", "f", "s", "1", 90.0, 0.0), ("ambiguous", "m", "q", "f", "s", "", 60.0, 58.0)], "status string, combined_molecule string, product string, manufacturer string, strength string, din string, top_score double, second_score double")
    assert [r.status for r in sinks.recon_tab(recon).collect()] == ["ambiguous", "matched"]


def test_compared_files(spark, tmp_path):
    (tmp_path / "old.csv").write_text('Product,Dollars MAT 2024/06,Units MAT 2024/06\nLIPITOR,"2,000,000","100,000"\nZANTAC,"800,000",1\n')
    (tmp_path / "new.csv").write_text('Product,Dollars MAT 12/2024,Units MAT 12/2024\nLIPITOR,"2,500,000","130,000"\nOZEMPIC,"5,000,000",2\n')
    path = str(tmp_path / "c.xlsx")
    warnings = api.compare_files(spark, str(tmp_path / "new.csv"), str(tmp_path / "old.csv"), path, ["Product"])
    assert warnings == ["the files were given the wrong way round"]
    found = xlsx.sheets(path)
    assert list(xlsx.rows(path, found["Moves"]))[0][:3] == ["Product", "Dollars 2024/06", "Units 2024/06"] and [r[0] for r in xlsx.rows(path, found["Exits"])][1:] == ["ZANTAC"] and [r[0] for r in xlsx.rows(path, found["Entrants"])][1:] == ["OZEMPIC"]
    assert sinks.comparison_name((2024, 6), None) == "comparison_2024-06_NA.xlsx"

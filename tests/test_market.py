import datetime as dt
import json

import pytest

from pyspark.sql import functions as F
from rxloom.functions.names import base_form, brand_identity, company_identity, computed_expiry, patent_numbers, solution_strength
from rxloom.functions.similarity import best_options, company_core, fuzzy_contains, ratio, strength_tokens, truncated_brand
from rxloom.operators import criteria, relational, sales
from rxloom.operators.matcher import generic_brand, match_groups, match_sales
from rxloom.operators.monograph import container_labels, contents_share, document_fields, fields, pack_size, page_fields, page_sections, ph_values, sections
from rxloom.sources.files import canary, extract_records, html_rows, html_tables, json_records, metric_period, sales_extract, table_json, write_tabs
from rxloom.streaming import jobs


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("100 MG", {"100MG"}), ("1 MG; 100 MG", {"1MG", "100MG"}), ("150MG/ML", {"150MG"}), ("0.6GM/300MG", {"600MG", "300MG"}), ("160/12.5MG", {"160MG", "12.5MG"}), ("10MG/G", {"1%"}), ("50M", {"50MG"}),
        ("8 %", {"8%"}), ("10.0MG", {"10MG"}), ("", set()), (None, set()), ("n/a", set()), ("5/10", {"5", "10"}),
    ],
)
def test_strength_tokens(text, want):
    assert set(strength_tokens(text)) == want


def test_similarity():
    assert company_core("Pfizer Canada S.E.C. / Limitée") == "pfizer" and company_core(None) == ""
    assert ratio("", "a") == 0 and ratio("abc", "abc") == 100
    assert best_options("metf", ["METFORMIN", "x"]) == ["METFORMIN"] and best_options("metfromin", ["METFORMIN", "ASPIRIN"]) == ["METFORMIN"] and best_options("zzz", ["a"]) == []
    assert truncated_brand("a b c", "a c") and not truncated_brand("b c", "a b c")
    assert fuzzy_contains("microcrystalline", "with microcrystaline cellulose") and not fuzzy_contains("talc", "xyz") and not fuzzy_contains("", "x")


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_names(spark):
    assert one(spark, "PFIZER CANADA, ULC", company_identity) == "pfizer"
    assert one(spark, "LIPITOR 20MG TABLETS", brand_identity) == "lipitor"
    assert one(spark, "Tablet (Extended-Release), oral", base_form) == "TABLET"
    assert one(spark, "CA 2,709,0253022097", patent_numbers) == ["2709025", "3022097"] and one(spark, " ", patent_numbers) == []
    assert one(spark, "25 MG", lambda c: solution_strength(c, F.lit("Oral Solution"))) == "25 MG/ML" and one(spark, "25 MG/5", lambda c: solution_strength(c, F.lit("Solution"))) == "25 MG/5"
    expiry = lambda c: computed_expiry(c.cast("date"))
    assert one(spark, "2008-02-29", expiry) == "2028-02-29" and one(spark, "2000-12-31", expiry) == "2020-12-31" and one(spark, "1989-09-30", expiry).startswith("verify") and one(spark, None, expiry) is None


def test_matcher_is_the_global_greedy_one(spark):
    cat = [(f"{i:08d}", f"MOL{'ABCDEFG'[i % 7] * 4} HYDROCHLORIDE", b, c, f"{10 * (1 + i % 3)}.0 MG", s) for i, (b, c, s) in enumerate(
        (f"{p}{'ABCDEFG'[i % 7] * 4}", f"{f} PHARMA INC", s) for i in range(21) for p, f, s in [("APO-MOL", "APOTEX", "Marketed"), ("PMS-MOL", "PENDOPHARM", "Marketed"), ("MOL", "APOTEX", "Approved"), ("TEVA-MOL", "TEVA", "Dormant")])]
    sold = [(f"MOL{x * 4}", b + x * 4, m, f"{10 * k}MG") for x in "ABCDEFG" for k in (1, 2, 3) for b, m in [("APO-MOL", "APOTEX"), ("PMS-MOL", "PENDOPHARM CANADA"), ("MOL", "APOTEX INC"), ("XX-MOL", "TEVA"), ("", "NOBODY")]]
    sold += [("MOLAAAA", "APO-MOLAAAA", "APOTEX", None), (None, "APO-MOLAAAA", "APOTEX", "10MG")]
    s = spark.createDataFrame(sold, "combined_molecule string, product string, manufacturer string, strength string")
    p = spark.createDataFrame(cat, "din string, ingredient string, brand_name string, company string, strength string, status string")
    got = {(r.combined_molecule, r.product, r.manufacturer, r.strength): (r.status, r.din) for r in match_sales(s, p).collect() if r.product is not None}
    want = {}
    groups, products = [], []
    for g in sorted(sold, key=lambda r: tuple(x or "" for x in r)):
        groups.append({"id": g, "brand": g[1].lower(), "company": company_core(g[2]), "molecule": g[0] or "", "key": (strength_tokens(g[3]), g[0])})
    for c in sorted(cat):
        if c[5].lower() != "approved":
            products.append({"din": c[0], "brand": c[2].lower(), "company": company_core(c[3]), "status": c[5].lower(), "key": (strength_tokens(c[4]), c[1].split()[0])})
    for k in {g["key"] for g in groups}:
        usable = k[0] and k[1]
        for r in match_groups([g for g in groups if g["key"] == k], [x for x in products if x["key"] == k] if usable else []):
            want[r[0]] = (r[1], r[2])
    assert got == want
    assert {v[0] for v in got.values()} >= {"matched", "no_match"}
    assert match_sales(s.limit(0), p).where("status <> 'not_sold'").count() == 0 and match_sales(s, p.limit(0)).where("status = 'matched'").count() == 0
    assert generic_brand("amlodipine", "AMLODIPINE") and not generic_brand("m-amlodipine", "AMLODIPINE") and not generic_brand("", "x")


def test_periods(spark):
    cols = "k string, dollars double, units double"
    old = spark.createDataFrame([("lipitor", 2e6, 1e5), ("gluco", 1e6, 5e4), ("zantac", 8e5, 1.0), ("pepcid", 3e5, 1.0), ("none", 0.0, 0.0)], cols)
    new = spark.createDataFrame([("lipitor", 2.5e6, 1.3e5), ("gluco", 1.04e6, 50_500.0), ("ozempic", 5e6, 1.0), ("pepcid", 0.0, 0.0)], cols)
    got = {r.k: (r.signal, r.dollars_percent) for r in sales.compare_periods(old, new, ["k"], ["dollars", "units"]).collect()}
    assert got == {"lipitor": ("move", 25.0), "gluco": ("steady", 4.0), "zantac": ("exit", -100.0), "ozempic": ("entrant", None), "pepcid": ("exit", -100.0)}


def test_criteria(spark):
    with pytest.raises(ValueError, match="unknown"):
        criteria.parse_criteria([{"metric": "x", "op": "above", "value": "1"}], {"n"})
    with pytest.raises(ValueError, match="could not convert"):
        criteria.parse_criteria([{"metric": "n", "op": "above", "value": "a"}], {"n"})
    df = spark.createDataFrame([(1, 5.0, "TABLET (ER); CREAM", None), (2, None, "GEL", dt.date(2024, 1, 1))], "id int, n double, forms string, day date")
    ids = lambda c: [r.id for r in df.where(c).collect()]
    assert ids(criteria.numeric([("n", "above", 4.0)])) == [1] and ids(criteria.numeric([("n", "exactly", 0.0)])) == [2] and ids(criteria.any_form(F.col("forms"), ["tablet"])) == [1]
    assert ids(criteria.by_date(F.col("day"), "less", dt.date(2024, 6, 1))) == [1, 2] and ids(criteria.by_date(F.col("day"), "greater", dt.date(2023, 6, 1))) == [2] and ids(criteria.by_date(F.col("day"), "equal", dt.date(2023, 6, 1))) == []


def test_relational(spark):
    a = spark.createDataFrame([("metformin",), ("met",), ("x",), ("abcdefgh",)], "a string")
    b = spark.createDataFrame([("metformin hcl",), ("metfor",), ("zabcdefghz",), ("",)], "b string")
    assert {tuple(r) for r in relational.containment_pairs(a, b).collect()} == {("metformin", "metformin hcl"), ("met", "metformin hcl"), ("metformin", "metfor"), ("met", "metfor"), ("abcdefgh", "zabcdefghz")}
    df = spark.createDataFrame([(1, "a", None), (2, " ", None)], "id int, v string, w string")
    assert {r.column_name: r.fill_rate for r in relational.fill_rates(df).collect()} == {"id": 1.0, "v": 0.5, "w": 0.0}
    assert relational.pruned(df, keep=("w",)).columns == ["id", "v", "w"] and relational.pruned(df).columns == ["id", "v"]
    assert relational.upsert(df, spark.createDataFrame([(2, "n", "m")], df.schema), ["id"]).where("id = 2").first().v == "n"


def test_files(spark, tmp_path):
    def write(name, rows):
        (tmp_path / name).write_bytes("\n".join(",".join(f'"{x}"' for x in r) for r in rows).encode("latin-1"))

    write("drug.txt", [["17", "", "Human", "02099233", "GLUCOPHAGE"], ["18", "", "Human", "", "NO DIN"]])
    write("ingred.txt", [["17", "1", "Métformine", "I", "500", "MG"], ["17", "2", "ASPIRIN", "I", "5", "MG"]])
    write("form.txt", [["17", "1", "TABLET", "Comprimé"]])
    write("route.txt", [["17", "1", "ORAL", "Orale"]])
    write("status.txt", [["17", "N", "APPROVED", "01-JAN-2000"], ["17", "Y", "MARKETED", "01-JAN-2001"]])
    write("comp.txt", [["17", "", "1", "SANOFI", "DIN_OWNER"]])
    r = extract_records(spark, str(tmp_path))
    x = r.first()
    assert r.count() == 1 and (x.ingredient, x.strength, x.form, x.status, x.company) == ("ASPIRIN; Métformine", "5 MG; 500 MG", "TABLET", "MARKETED", "SANOFI")
    assert canary(r, "02099233", "GLUCO", "TABLET") == [] and canary(r, "1", "", "") == ["1 is missing"] and canary(r, "02099233", "OTHER", "TABLET") == ["brand"]
    (tmp_path / "one.json").write_text(json.dumps({"code": 1, "name": "a"}))
    (tmp_path / "many.json").write_text(json.dumps([{"code": 2}, {"code": 3, "name": "b"}]))
    assert sorted(y.code for y in json_records(spark, str(tmp_path / "*.json"), "code int, name string").collect()) == [1, 2, 3]
    (tmp_path / "s.csv").write_text('﻿Product,Dollars MAT 2024/06,Units MAT 06/2024\nLIPITOR,"2,000,000",-\n,,"1 000.7"\n')
    df, metrics = sales_extract(spark, str(tmp_path / "s.csv"))
    assert [tuple(y) for y in df.collect()][0] == ("LIPITOR", 2_000_000, 0) and df.collect()[1][2] == 1000 and set(metrics.values()) == {("dollars", (2024, 6)), ("units", (2024, 6))}
    (tmp_path / "bad.csv").write_text("Product,Units MAT 2024/06\nA,lots\n")
    with pytest.raises(ValueError, match="lots"):
        sales_extract(spark, str(tmp_path / "bad.csv"))
    assert metric_period("Ext Units MAT 12/2025") == ("ext_units", (2025, 12)) and metric_period("Product") is None
    write_tabs(str(tmp_path / "out"), {"main": r, "notes": df}, "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/main")).count() == 1
    assert table_json(df)["columns"][0] == "Product"


def test_html(spark):
    page = "<table><tr><th>A</th><th>B</th></tr><tr><td>x <b>y</b></td><td>&amp;</td></tr></table><table><tr><td>z"
    assert html_rows(page) == [(0, ["A", "B"]), (0, ["x, y", "&"])] and html_rows(None) == []
    got = html_tables(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", least_cells=2).collect()
    assert [(r.id, r.cells) for r in got] == [(1, ["A", "B"]), (1, ["x, y", "&"])]


@pytest.mark.parametrize(
    ("text", "style", "size"),
    [
        ("FOR I.V. INFUSION ONLY. 80MG/ML(RECONST.) - 5ML VIAL.", ["Vial"], "5 mL"), ("24/50/100/200", [], "24, 50, 100, 200 count"), ("1ML PREFILLED SYRINGE", ["Prefilled Syringe"], "1 mL"), ("BLISTER PACK 100/500", ["Blister Pack"], "100, 500 count"),
        ("8 COUNT BLISTERS AND BOTTLES OF 120 CAPSULES", ["Blister", "Bottle"], "8-count blister; 120-count bottle"), ("8 COUNT BLISTERS", ["Blister"], "8 count"), ("20g/50g/500g", [], "20 g, 50 g, 500 g"), ("100 TABLETS", [], "100 count"), ("", [], None), (None, [], None),
    ],
)
def test_pack_sizes(text, style, size):
    assert pack_size(text) == size and container_labels(text or "") == style


def test_monograph(spark):
    assert container_labels("Blister packs and bottles of 30; 1 mL prefilled syringe") == ["Prefilled Syringe", "Blister Pack", "Bottle"]
    assert contents_share(["A ..... 3", "b", ""]) == 0.5 and ph_values("at pH 6.8") == "6.8" and ph_values("pH 5 to 7") == "5-7" and ph_values("pH 21") is None
    df = spark.createDataFrame([(1, "Light pink oval tablets, 8.1 x 4 mm, in bottles of 30.\nPACKAGING ..... 4\nPACKAGING\nVials\n2 NEXT\nx"), (2, None)], "doc_id long, text string")
    r = {x.doc_id: x for x in document_fields(df).collect()}
    assert (r[1].color, r[1].shape, r[1].size_mm, r[1].pack_count) == ("light pink", "oval", "8.1 x 4", "30") and r[2].pack_style is None
    assert [(x.first_line, x.text) for x in sections(df, "^PACKAGING", "^2 ").collect()] == [(4, "Vials")]


PAGED = "page_id long, monograph_id long, page int, text string"


@pytest.mark.parametrize("size", [1, 2, 1024])
def test_monograph_pages(spark, monkeypatch, size):
    import rxloom.operators.monograph as monograph

    monkeypatch.setattr(monograph, "PAGES", size)
    texts = ["Oval tablets\nPACKAGING", "Blister packs of 30\nPACKAGING.", None, "see\nPACKAGING\nbottles of", "100 vials\n2 NEXT\nx\n3 END\nPACKAGING\nyes\n4 PACKAGING", "pH 6.8\n5 MORE", "white\nPACKAGING ..... 4\nPACKAGING"]
    rows = [(i, 1, i + 1, t) for i, t in enumerate(texts)] + [(9, 1, 2, texts[1]), (10, 1, 4, ""), (11, 2, 5, "pH 5\nPACKAGING\nbag"), (12, None, 5, "PACKAGING\nvial"), (13, None, 6, "jar"), (14, 3, None, None)]
    df = spark.createDataFrame(rows, PAGED).repartition(3)
    got: dict = {}
    for r in sorted(page_sections(df, "^(4 )?PACKAGING", "^[2-9] ").collect(), key=lambda r: r.part):
        got.setdefault((r.monograph_id, r.page, r.first_line), []).append(r.text)
    want = {
        (1, 1, 3): "Blister packs of 30\nPACKAGING.\nsee\nPACKAGING\nbottles of\n100 vials", (1, 5, 6): "yes", (1, 5, 8): "pH 6.8", (1, 7, 4): "", (2, 5, 3): "bag", (None, 5, 2): "vial",
    }
    assert {k: "\n".join(x for x in v if x) for k, v in got.items()} == want
    said = {r.monograph_id: tuple(r)[1:] for r in page_fields(df).where("monograph_id IS NOT NULL").collect()}
    assert said == {1: fields("\n".join(t for t in texts if t)), 2: fields(rows[9][3]), 3: fields(None)}
    assert page_fields(df).where("monograph_id IS NULL").count() == 2


def test_streams(spark, tmp_path):
    src, t = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=i), i % 3, "e", 1.0, "{}") for i in range(30)]
    spark.createDataFrame(rows, jobs.EVENTS).coalesce(1).write.parquet(src)
    spark.createDataFrame(rows[:10] + [(99, t + dt.timedelta(days=3), 0, "late", 1.0, "{}")], jobs.EVENTS).coalesce(1).write.mode("append").parquet(src)

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
        return spark.sql(f"SELECT * FROM {name}").collect()

    assert len(drain(jobs.replayed(jobs.event_stream(spark, src, 10)), "replay")) == 31
    assert sum(r.done for r in drain(jobs.progress(jobs.event_stream(spark, src)), "progress") if r.day == t) >= 30
    out = str(tmp_path / "latest")
    heard: list = []
    listener = jobs.Progress(lambda n, all_: heard.append((n, all_)))
    spark.streams.addListener(listener)
    jobs.merge_into(jobs.event_stream(spark, src), out, ["user_id"], str(tmp_path / "c"), buckets=2).awaitTermination()
    got = {r.user_id: r.event_id for r in jobs.current(spark, out, jobs.EVENTS).collect()}
    assert got == {0: 99, 1: 28, 2: 29}
    # a batch of its own touches only the bucket of its key; older events change nothing; what a failed batch left isn't read
    before = jobs._manifest(spark, out)
    spark.createDataFrame([(200, t + dt.timedelta(days=9), 1, "e", 1.0, "{}"), (201, t - dt.timedelta(days=9), 1, "e", 1.0, "{}")], jobs.EVENTS).coalesce(1).write.mode("append").parquet(src)
    jobs.merge_into(jobs.event_stream(spark, src), out, ["user_id"], str(tmp_path / "c"), buckets=2).awaitTermination()
    after = jobs._manifest(spark, out)
    assert sum(before[b] != after[b] for b in before) == 1
    spark.createDataFrame([(7, t, 1, "bad", 1.0, "{}")], jobs.EVENTS).write.parquet(f"{out}/bucket=0/version=999")
    assert {r.user_id: r.event_id for r in jobs.current(spark, out, jobs.EVENTS).collect()} == {0: 99, 1: 200, 2: 29}
    spark.streams.removeListener(listener)
    assert heard and heard[-1][1] == sum(n for n, _ in heard) >= 41


def test_scale_case(spark):
    """4,000 products with molecules, companies and strengths of their own, every fourth with a sales group: 1,000 matches, in well under 30 s."""
    import time

    letters = "".join(chr(65 + i) for i in range(26))
    word = lambda i: "MOL" + "".join(letters[(i // 26**k) % 26] for k in range(4))
    products = spark.createDataFrame([(f"{i:08d}", word(i), f"BRAND{word(i)}", f"COMP{word(i)} PHARMA INC", f"{i + 1} MG", "Marketed") for i in range(4000)], "din string, ingredient string, brand_name string, company string, strength string, status string")
    sold = spark.createDataFrame([(word(i), f"BRAND{word(i)}", f"COMP{word(i)}", f"{i + 1}MG") for i in range(0, 4000, 4)], "combined_molecule string, product string, manufacturer string, strength string")
    match_sales(sold.limit(1), products.limit(1)).count()  # a session of its own would be timed else
    t = time.time()
    got = {r.status: r["count"] for r in match_sales(sold, products).groupBy("status").count().collect()}
    took = time.time() - t
    print(f"scale case: {took:.1f} s")
    assert got == {"matched": 1000, "not_sold": 3000}
    assert took < 30


def test_audit(spark):
    from rxloom.operators.audit import audit_matches, audit_pair, better, decompose

    assert better(80, [(90, "a")]) is None and better(80, [(96, "a"), (95, "b")]) == (96, "a") and better(90, [(100, "a")]) == (100, "a") and better(10, [(50, "a")]) is None and better(5, []) is None
    assert decompose((5, 7), [(1, 1), (2, 3), (3, 4), (2, 3)]) == (1, 2) and decompose((6, 8), [(1, 1), (2, 3), (3, 4)]) == (0, 1, 2) and decompose((9, 9), [(9, 9)]) is None
    g = {"product": "P", "manufacturer": "ACME", "brand": "zzz", "company": "acme", "molecule": "ZZZ"}
    p = {"din": "1", "brand": "acme-brando", "company": "acme"}
    assert audit_pair(g, p, [g], [p])[5:] == ("company_carried", "", pytest.approx(72 - ratio("acme-brando", "zzz"), abs=0.1), "low")
    swap = {"din": "2", "brand": "zzz", "company": "acme"}
    assert audit_pair(g, p, [g], [p, swap])[5:7] == ("company_carried,better_product", "2")
    sold = spark.createDataFrame([("MOLX", "PMS-MOLX", "PMS", "10MG"), ("MOLX", "APO-MOLX", "APOTEX", "10MG"), (None, "Q", "PMS", "5MG")], "combined_molecule string, product string, manufacturer string, strength string")
    products = spark.createDataFrame([("1", "MOLX", "PRZ-MOLX", "PMS INC", "10 MG", "marketed"), ("2", "MOLX", "PMS-MOLX", "PMS INC", "10 MG", "marketed"), ("3", "MOLX", "APO-MOLX", "APOTEX", "10 MG", "marketed")], "din string, ingredient string, brand_name string, company string, strength string, status string")
    wrong = sold.withColumn("din", F.when(F.col("product") == "PMS-MOLX", "1").when(F.col("product") == "APO-MOLX", "3").otherwise(""))
    got = {r.din: r for r in audit_matches(wrong, sold, products).collect()}
    assert got["1"].flags == "better_product" and got["1"].rival == "2" and got["3"].flags == "" and got["3"].tier == "none" and len(got) == 2
    assert audit_matches(wrong.limit(0), sold, products).count() == 0


def test_audit_rivals():
    """The best rivals are those of all pairs compared, ties, own rows and empty texts included, and few ratios are taken for them."""
    import random

    import rxloom.operators.audit as audit
    from rxloom.functions.similarity import Alike, common, reaches

    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcé-1 ") for _ in range(rnd.randint(0, n)))
    for a, b in [(text(12), text(12)) for _ in range(2000)] + [("ab" * 150, "ab" * 150), ("a" * 300, "a" * 299)]:
        least = rnd.choice([30, 55, 100 * 2 / 3, 100])
        r = ratio(a, b)
        assert reaches(a, b, least) == (r >= least)
        assert r <= 200 * common(a, b) / max(1, len(a) + len(b)) + 1e-9
        assert r < least or b in [t for _, t in Alike([a, b]).to(a, least)]
    firm, brand = [text(9) for _ in range(12)], [text(10) for _ in range(150)]
    groups = [{"product": f"P{i % 40}", "manufacturer": "M", "brand": rnd.choice(brand), "company": rnd.choice(firm), "molecule": "ab c"} for i in range(300)]
    products = [{"din": str(i), "brand": rnd.choice(brand), "company": rnd.choice(firm)} for i in range(250)]

    def brute(g, p):
        own = ratio(p["brand"], g["brand"])
        akin = [o for o in products if ratio(o["company"], g["company"]) >= 55]
        one = audit.better(own, [(ratio(o["brand"], g["brand"]), o["din"]) for o in akin if o["din"] != p["din"]])
        two = audit.better(own, [(ratio(p["brand"], o["brand"]), o["product"]) for o in groups if o is not g and ratio(p["company"], o["company"]) >= 55])
        flags = ["company_carried"] * (own < 72) + ["better_product"] * bool(one) + ["better_group"] * bool(two)
        forced = flags == ["company_carried"] and len(akin) == 1 and (audit.generic_brand(g["brand"], g["molecule"], audit.GENERIC_FILLERS) or audit.truncated_brand(g["brand"], p["brand"]))
        return ",".join(flags), ",".join(x[1] for x in (one, two) if x), "low" if forced else "high" if flags else "none"

    sides = audit.Rivals(groups, "product"), audit.Rivals(products, "din")
    pairs = [(g, rnd.choice(products)) for g in groups]
    got = [audit.audit_pair(g, p, *sides) for g, p in pairs]
    assert [(r[5], r[6], r[8]) for r in got] == [brute(g, p) for g, p in pairs]
    assert {r[5] for r in got} >= {"company_carried,better_product", "company_carried,better_group"}


def test_audit_work(monkeypatch):
    """2,000 groups and products of one strength with brands of their own: a few ratios a pair, not one with every rival."""
    import random

    import rxloom.operators.audit as audit
    import rxloom.functions.similarity as similarity

    rnd, taken = random.Random(1), [0]
    word = lambda n: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(n))

    def counted(a, b):
        taken[0] += 1
        return ratio(a, b)

    monkeypatch.setattr(audit, "ratio", counted)
    monkeypatch.setattr(similarity, "ratio", counted)
    products = [{"din": str(i), "brand": word(5), "company": word(6)} for i in range(2000)]
    groups = [{"product": p["brand"], "manufacturer": p["company"], "brand": p["brand"] if i % 2 else p["brand"][:6], "company": p["company"], "molecule": "x"} for i, p in enumerate(products)]
    sides = audit.Rivals(groups, "product"), audit.Rivals(products, "din")
    assert len([audit.audit_pair(g, p, *sides) for g, p in zip(groups[:200], products)]) == 200
    assert taken[0] < 20 * 200


def test_audit_unmatched(spark):
    """A group that has no product is no pair, whatever products lack a number; those aren't named as rivals. Of a repeated number the first brand counts."""
    from rxloom.operators.audit import audit_matches

    sold = spark.createDataFrame([("MOLX", "PMS-MOLX", "PMS", "10MG", "1"), ("MOLX", "LONE", "APOTEX", "10MG", None), ("MOLY", "ABA", "TEVA", "5MG", "4")], "combined_molecule string, product string, manufacturer string, strength string, din string")
    rows = [("1", "MOLX", "PRZ-MOLX", "PMS INC", "10 MG"), (None, "MOLX", "PMS-MOLX", "PMS INC", "10 MG"), (" ", "MOLX", "PMS-MOLX", "PMS INC", "10 MG"), ("4", "MOLY", "ZZZ", "TEVA", "5 MG"), ("4", "MOLY", "ABA", "TEVA", "5 MG"), ("4", "MOLY", "QQQ", "TEVA", "5 MG")]
    products = spark.createDataFrame([(*r, "marketed") for r in rows], "din string, ingredient string, brand_name string, company string, strength string, status string")
    got = {r.din: (r.product, r.brand_sim, r.flags, r.rival) for r in audit_matches(sold, sold, products).collect()}
    assert set(got) == {"1", "4"} and got["4"] == ("ABA", 100.0, "", "") and got["1"][2:] == ("", "")

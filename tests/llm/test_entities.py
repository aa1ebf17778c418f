import datetime as dt

import pytest

from rxloom.llm.entities import brand_tokens, match
from pyspark.sql import functions as F

SALES = "row_id long, line_key long, snapshot_no int, loaded_at timestamp, product string, manufacturer string, strength string, combined_molecule string, firm string"
CAT = "row_id long, drug_code int, brand_name string, company_name string, company_code int, last_update_date string"
ING = "drug_code int, ingredient_name string, strength string, strength_unit string"
T = dt.datetime(2024, 1, 1)
#: Planted: each line of a catalogue drug, one by its cut brand, one without a firm.
TRUTH = {(1000 + code, code) for code in range(100, 136)} | {(4, 101), (5, 102)}


def tables(spark):
    firms = [("ALFA THERAPEUTICS CANADA INC.", "Alfa Therapeutics Cda Inc"), ("BRAVOKIS LABORATORIES LTD", "Bravokis Labs Ltd")]
    names = spark.createDataFrame([(2 * i + j, n) for i, f in enumerate(firms) for j, n in enumerate(f)], "name_id long, spelling string")
    brands = ["ZAKATEDEXO", "SARUZUXEL", "DAFALEVORA", "TEKINUMIOR", "PELEKELENZ", "MULADARYL"]
    cat, ing, sales = [], [], []
    for i, b in enumerate(brands * 2):
        for k, mg in enumerate((5, 10, 20)):
            code = 100 + len(cat)
            cat.append((code, code, b if i < 6 else b[::-1], firms[i % 2][0], i % 2, "2020-01-01"))
            ing.append((code, f"MOL{i}X", str(mg * 1000), "MCG"))
            typo = cat[-1][2] if k else cat[-1][2][:3] + cat[-1][2][4:]
            sales.append((len(sales), 1000 + code, 1, T, f"{typo} {mg}MG TABLETS", firms[i % 2][1], f"{mg} MG", f"MOL{i}X", None))
    sales += [
        (900, 1, 1, T, "ZAKATEDEXO", firms[0][1], "40 MG", "MOL0X", None), (901, 2, 1, T, None, None, None, None, None), (902, 3, 1, T, "UNKNOWNBRAND", firms[0][1], "5 MG", "MOL99X", None),
        (903, 1100, 2, T, "ZAKAEDEXO 5MG TABLETS", firms[0][1], "5000 mcg", "MOL0X", None), (904, 4, 1, T, "ALFA ZAKATEDE", firms[0][1], "10MG", "MOL0X", None), (905, 5, 1, T, "ZAKATEDEXO", None, "20 MG", "MOL0X", None),
    ]
    return spark.createDataFrame(sales, SALES), spark.createDataFrame(cat, CAT), spark.createDataFrame(ing, ING), names


def test_matches(spark):
    s, c, i, n = tables(spark)
    got = {r.line_key: r for r in match(s, c, i, n, 4).collect()}
    assert {(k, r.drug_code) for k, r in got.items()} == TRUTH
    assert all(0.5 <= r.posterior <= 1.000001 for r in got.values())


@pytest.fixture
def linked(spark, monkeypatch):
    """The firms of the four spellings, without linking them again."""
    import rxloom.llm.entities as entities

    monkeypatch.setattr(entities, "link_names", lambda names, rows: spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "name_id long, firm long"))


def test_empty(spark, linked):
    s, c, i, n = tables(spark)
    assert match(s.limit(0), c, i, n, 4).count() == 0
    assert match(s, c.limit(0), i.limit(0), n, 4).count() == 0


def test_brand_words(spark):
    cases = {"TAB KOLUFUMEXO 0.3Grams": ["KOLUFUMEXO"], "MUMU® - CAP 2.50MG/125micrograms": ["MUMU"], "LOD-ZEVO 500.0IU INJECTION": ["LOD", "ZEVO"], "5MG TABLETS": ["5MG", "TABLETS"], "A 10MG/ML SOLUTION": ["A"]}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.w for r in df.select("p", brand_tokens(F.col("p")).alias("w")).collect()} == cases


def test_hot_blocks_are_split_without_loss(spark, monkeypatch, linked):
    import rxloom.llm.entities as entities

    s, c, i, n = tables(spark)
    monkeypatch.setattr(entities, "BLOCK_ROWS", 1)
    assert {(r.line_key, r.drug_code) for r in match(s, c, i, n, 4).collect()} == TRUTH


def test_a_hand_rule_finds_less(spark, monkeypatch, linked):
    import rxloom.llm.entities as entities

    s, c, i, n = tables(spark)
    rule = lambda self: F.when((F.col("brand_sim") >= 0.75) & (F.col("firm_sim") >= 0.75) & (F.col("strength_sim") >= 0.75), 999.0).otherwise(0.001)
    monkeypatch.setattr(entities.Mixture, "odds", rule)
    by_rule = {(r.line_key, r.drug_code) for r in match(s, c, i, n, 4).collect()}
    assert len(TRUTH & by_rule) < len(TRUTH)


PROFILE = "id long, brand string, whole string, firm string, firm_key string, strengths string, molecules string, form string"


def model():
    import numpy as np

    from rxloom.llm.entities import Mixture

    return Mixture(0.3, np.array([[0.55, 0.5, 0.1, 0.5, 0.5], [0.96, 1.0, 1.0, 1.0, 0.8]]), np.array([[0.17, 0.17, 0.05, 0.25, 0.25], [0.01, 0.0025, 0.0025, 0.0025, 0.15]]))


def test_profiles_of_a_drug_must_be_one_product(spark):
    from rxloom.llm.entities import best_drugs, consistent

    brands = ["ZAKATEDEXO", "ZAKATDEXO", "QQWWRRTT"]
    profiles = spark.createDataFrame([(i, b, b, "1", "ALFA", "mass:5", "M", "TAB") for i, b in enumerate(brands)], PROFILE)
    pairs = spark.createDataFrame([(0, 7, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 7, 0.9, 1.0, 1.0, 1.0, 1.0), (2, 7, 0.8, 1.0, 1.0, 1.0, 1.0)], "a long, b long, brand_sim double, firm_sim double, strength_sim double, molecule_sim double, form_sim double")
    best = best_drugs(pairs, model())
    assert {r.a for r in best.collect()} == {0, 1, 2}
    assert {r.a for r in consistent(best, profiles, model()).collect()} == {0, 1}


def test_candidates_of_a_profile_compete(spark):
    from rxloom.llm.entities import best_drugs

    sims = "a long, b long, brand_sim double, firm_sim double, strength_sim double, molecule_sim double, form_sim double"
    tie = spark.createDataFrame([(1, 7, 1.0, 1.0, None, 1.0, None), (1, 8, 1.0, 1.0, None, 1.0, None), (2, 7, 1.0, None, 1.0, 1.0, 1.0), (2, 9, 1.0, None, 1.0, 1.0, 0.0)], sims)
    got = {r.a: (r.b, r.posterior) for r in best_drugs(tie, model()).collect()}
    assert set(got) == {2} and got[2][0] == 7 and 0.5 < got[2][1] < 1


def test_column_and_batches_agree_and_fit_separates(spark):
    import numpy as np

    from rxloom.llm.entities import FEATURES, fit

    rng = np.random.default_rng(1)
    rows = []
    for a in range(300):
        rows.append((a, *[float(x) for x in np.round(np.clip([1 - rng.exponential(0.03), 1.0, 1.0, 1.0], 0, 1), 2)], None if a % 3 else 1.0))
        rows += [(a, round(float(rng.uniform()), 2), float(rng.integers(2)), 0.0, float(rng.integers(2)), float(rng.integers(2))) for _ in range(3)]
    df = spark.createDataFrame(rows, "a long, " + ", ".join(f"{f} double" for f in FEATURES))
    m = fit(df)
    assert 0.2 < m.weight < 0.3 and m.means[1, 0] > 0.9 and m.means[0, 2] < 0.1
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows], float)
    col = [r.o for r in df.select(m.odds().alias("o")).collect()]
    assert np.allclose(np.log(col), np.log(m.odds_of(x)), atol=1e-6)
    assert fit(df.limit(0)) is None

"""Queries of the market-record operators over the project's tables, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxloom.functions import names as N
from rxloom.functions.similarity import company_core_udf, strength_key_udf
from rxloom.functions.text import amount, any_date, normalize_din
from rxloom.operators import audit, criteria, matcher, monograph, relational, sales
from rxloom.operators import findings as dq
from rxloom.plans.core_problems import _AMOUNT, _DATE
from rxloom.sources.tables import table

AS_OF = "2025-01-01"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def text(c: str) -> F.Column:
    return F.coalesce(F.col(c), F.lit(""))


# --- scalar functions -------------------------------------------------------------------------------------------------

_DIN = "CASE WHEN regexp_replace({c}, '\\D', '', 'g') = '' THEN NULL WHEN length(regexp_replace({c}, '\\D', '', 'g')) >= 8 THEN regexp_replace({c}, '\\D', '', 'g') ELSE lpad(regexp_replace({c}, '\\D', '', 'g'), 8, '0') END"


@query(f"SELECT line_no, {_DIN.format(c='din')} AS din, coalesce(regexp_matches({_DIN.format(c='din')}, '^[0-9]{{8}}$'), false) AS is_valid FROM patent_bulk")
def din_normalized(spark: SparkSession, d: str) -> DataFrame:
    din = normalize_din(F.col("din"))
    return table(spark, d, "patent_bulk").select("line_no", din.alias("din"), F.coalesce(din.rlike("^[0-9]{8}$"), F.lit(False)).alias("is_valid"))


@query(
    f"""SELECT row_id, u.i AS pos, {_DIN.format(c="u.x")} AS din FROM (SELECT row_id, regexp_split_to_array(din || '; ' || drug_code || ', DIN ' || row_id, '[;,\\s]+') AS a FROM store_labeling),
 unnest(list_transform(generate_series(1, len(a)), lambda i: {{'i': i, 'x': a[i]}})) t(u) WHERE {_DIN.format(c="u.x")} IS NOT NULL"""
)
def dins_parsed(spark: SparkSession, d: str) -> DataFrame:
    packed = F.concat("din", F.lit("; "), "drug_code", F.lit(", DIN "), "row_id")
    parts = table(spark, d, "store_labeling").select("row_id", F.posexplode(F.split(packed, r"[;,\s]+")).alias("p", "x"))
    return parts.select("row_id", (F.col("p") + 1).cast("long").alias("pos"), normalize_din(F.col("x")).alias("din")).where("din IS NOT NULL")


_NAME = "upper(trim(regexp_replace(regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^[ ,;]+|[ ,;]+$', '', 'g'), '\\s+', ' ', 'g')))"


@query(
    f"""WITH k AS (SELECT drug_code, array_to_string(list_sort(list(DISTINCT {_NAME.format(c="ingredient_name")})), ' + ') AS key FROM activeingredient WHERE {_NAME.format(c="ingredient_name")} <> '' GROUP BY drug_code),
 c AS (SELECT DISTINCT drug_code, company_name FROM drugproduct)
 SELECT coalesce(key, 'UNKNOWN / UNPARSED') AS combination, count(DISTINCT k.drug_code) AS drugs, count(DISTINCT company_name) AS companies FROM k LEFT JOIN c USING (drug_code) GROUP BY 1"""
)
def combination_groups(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "activeingredient").select("drug_code", N.normalize_name(F.col("ingredient_name")).alias("n")).where("n <> ''")
    keys = named.groupBy("drug_code").agg(F.array_sort(F.collect_set("n")).alias("k"))
    firms = table(spark, d, "drugproduct").select("drug_code", "company_name").distinct()
    return keys.join(firms, "drug_code", "left").groupBy(N.label(F.col("k")).alias("combination")).agg(F.count_distinct("drug_code").alias("drugs"), F.count_distinct("company_name").alias("companies"))


_TAIL = N.DOSE_TAIL
_DOSED = "ingredient_name || ' 10 MG/5 ML'"
_IKEY = f"list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(coalesce({{c}}, ''), '[;+]'), lambda p: {_NAME.format(c=f'''regexp_replace(trim(p), '(?i){_TAIL}', '')''')}), lambda x: x <> '')))"


@query(f"SELECT row_id, array_to_string({_IKEY.format(c=_DOSED)}, '|') AS ingredient_key, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(ingredient_name), '([a-z]{{3,}})', 1), lambda w: w NOT IN ({', '.join(repr(w) for w in N.SALT_WORDS)})))), ' ') AS tokens FROM activeingredient WHERE ingredient_name IS NOT NULL")
def ingredient_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "activeingredient").where("ingredient_name IS NOT NULL")
    return rows.select("row_id", F.array_join(N.ingredient_key(F.concat("ingredient_name", F.lit(" 10 MG/5 ML"))), "|").alias("ingredient_key"), F.array_join(N.molecule_tokens(F.col("ingredient_name")), " ").alias("tokens"))


@query(
    f"""SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(translate(lower(company_name), '{N.ACCENTED}', '{N.PLAIN}'), '[.,/&]', ' ', 'g'), '\\b(?:incorporated|inc|limited|limitee|ltee|ltd\\b|llc|llp|ulc|corporation|corp|co\\b|sa\\b|ag\\b|gmbh|plc|sencrl|senc|sec\\b|a division of|division|healthcare|health|consumer|canada)', ' ', 'g'), '\\s+', ' ', 'g')) AS company,
 lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(brand_name, '\\s+', ' ', 'g')), '(?i)\\s+\\d[\\d.\\s]*(?:%|mg|mcg|ug|g\\b|ml|iu|miu|units?|cap|capsule|tablet|tab|pak\\b|pack).*$', ''), '(?i)\\s+(?:tablets?|capsules?|caps?|injections?|solution|suspension|cream|ointment|gel|patch|spray|drops?|syrup|elixir|lotion)\\s*$', ''))) AS brand
 FROM drugproduct WHERE company_name IS NOT NULL AND brand_name IS NOT NULL"""
)
def identities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "drugproduct").where("company_name IS NOT NULL AND brand_name IS NOT NULL")
    return rows.select("row_id", N.company_identity(F.col("company_name")).alias("company"), N.brand_identity(F.col("brand_name")).alias("brand"))


@query("SELECT row_id, CASE WHEN form_3 LIKE 'SOL%' AND NOT contains(strength, '/') AND regexp_matches(trim(strength), '(?i)^\\d[\\d.,]*\\s*(?:mg|mcg|g|ug)$') THEN trim(strength) || '/ML' ELSE strength END AS strength FROM old_extract")
def solution_strengths(spark: SparkSession, d: str) -> DataFrame:
    form = F.when(F.col("form_3").startswith("SOL"), "Solution").otherwise("Other")
    return table(spark, d, "old_extract").select("row_id", N.solution_strength(F.col("strength"), form).alias("strength"))


@query(
    """WITH c AS (SELECT line_no, regexp_replace(regexp_replace(trim(patent_number || CASE WHEN line_no % 7 = 0 THEN '1234567' ELSE '' END), '(?i)^ca\\s*', ''), '[,\\s]+', '', 'g') AS n FROM patent_bulk WHERE patent_number IS NOT NULL)
 SELECT line_no, n AS patent_number FROM c WHERE n <> '' AND NOT regexp_matches(n, '^\\d{14}$')
 UNION ALL SELECT line_no, substr(n, 1, 7) FROM c WHERE regexp_matches(n, '^\\d{14}$') UNION ALL SELECT line_no, substr(n, 8, 7) FROM c WHERE regexp_matches(n, '^\\d{14}$')"""
)
def patent_numbers_split(spark: SparkSession, d: str) -> DataFrame:
    merged = F.concat("patent_number", F.when(F.col("line_no") % 7 == 0, "1234567").otherwise(""))
    return table(spark, d, "patent_bulk").select("line_no", F.explode(N.patent_numbers(merged)).alias("patent_number"))


@query(
    f"""SELECT line_no, strftime(filed, '%Y-%m-%d') AS filed, CASE WHEN filed >= DATE '1989-10-01' THEN strftime(filed + INTERVAL 240 MONTH, '%Y-%m-%d') WHEN filed IS NOT NULL THEN '{N.UNSURE_TERM}' END AS expiry
 FROM (SELECT line_no, {_DATE.format(c="filing_date")} AS filed FROM patent_bulk)"""
)
def computed_expiries(spark: SparkSession, d: str) -> DataFrame:
    filed = any_date(F.col("filing_date"))
    return table(spark, d, "patent_bulk").select("line_no", F.date_format(filed, "yyyy-MM-dd").alias("filed"), N.computed_expiry(filed).alias("expiry"))


@query(
    """SELECT noc_number, row_id, CASE WHEN upper(trim(coalesce(noc_status_with_conditions, ''))) IN ('YES', 'Y', '1', 'OUI') THEN 'Yes' ELSE 'No' END AS with_conditions,
 sha256('noc:' || noc_number) AS cache_key, regexp_matches(coalesce(noc_on_submission_type, ''), '(?i)supplement to|\\b(snds|sands)\\b') AS is_supplement FROM api_main"""
)
def approval_flags(spark: SparkSession, d: str) -> DataFrame:
    kind = text("noc_on_submission_type").rlike(r"(?i)supplement to|\b(snds|sands)\b")
    return table(spark, d, "api_main").select("noc_number", "row_id", N.yes_flag(F.col("noc_status_with_conditions")).alias("with_conditions"), F.sha2(F.concat(F.lit("noc:"), F.col("noc_number").cast("string")), 256).alias("cache_key"), kind.alias("is_supplement"))


@query("SELECT upper(trim(regexp_extract(form_3 || ', ' || channel, '^([^(,]*)', 1))) AS base_form, array_to_string(list_sort(list(DISTINCT form_3 || ', ' || channel)), '; ') AS variants FROM old_extract WHERE form_3 IS NOT NULL AND channel IS NOT NULL GROUP BY 1")
def dosage_form_map(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("form_3", F.lit(", "), "channel")
    rows = table(spark, d, "old_extract").select(raw.alias("raw")).where("raw IS NOT NULL").distinct()
    return rows.groupBy(N.base_form(F.col("raw")).alias("base_form")).agg(F.array_join(F.array_sort(F.collect_set("raw")), "; ").alias("variants"))


# --- scans and searches -----------------------------------------------------------------------------------------------


_TERMS = "t AS (SELECT (SELECT lower(substr(max(ingredient_name), 1, 4)) FROM activeingredient) AS a, (SELECT lower(substr(max(brand_name), 1, 4)) FROM drugproduct) AS b, (SELECT upper(substr(max(noc_pi_medic_ingr_name), 1, 5)) FROM api_medicinalingredient) AS n)"


def _term(t: DataFrame, c: str, n: int) -> str:
    """First letters of the last name there is, for a search of any data."""
    return (t.agg(F.max(c)).first()[0] or "")[:n]


def search_catalogue(ingredients: DataFrame, products: DataFrame, terms: list[str], brands: list[str] = (), companies: list[str] = (), most: int = 150) -> DataFrame:
    """Records of the codes that any term fits, sorted by code and capped, with the number of codes before the cap."""
    hit = lambda t, c, some: [t.where(F.contains(F.lower(c), F.lit(x.lower()))).select("drug_code") for x in some]
    found = [*hit(ingredients, "ingredient_name", terms), *hit(products, "brand_name", brands), *hit(products, "company_name", companies)]
    codes = found[0]
    for f in found[1:]:
        codes = codes.union(f)
    codes = codes.distinct()
    total = F.lit(codes.count()).cast("long").alias("total_matches")
    return products.join(F.broadcast(codes.orderBy("drug_code").limit(most)), "drug_code", "left_semi").select("drug_code", "row_id", "brand_name", total)


@query(f"""WITH {_TERMS}, c AS (SELECT DISTINCT drug_code FROM activeingredient, t WHERE contains(lower(ingredient_name), a) UNION SELECT DISTINCT drug_code FROM drugproduct, t WHERE contains(lower(brand_name), b)),
 k AS (SELECT drug_code FROM c ORDER BY drug_code LIMIT 150) SELECT p.drug_code, p.row_id, p.brand_name, (SELECT count(*) FROM c) AS total_matches FROM drugproduct p SEMI JOIN k USING (drug_code)""")
def catalogue_search(spark: SparkSession, d: str) -> DataFrame:
    a, p = table(spark, d, "activeingredient"), table(spark, d, "drugproduct")
    return search_catalogue(a, p, [_term(a, "ingredient_name", 4)], [_term(p, "brand_name", 4)])


def search_approvals(ingredients: DataFrame, main: DataFrame, term: str, most: int = 200) -> DataFrame:
    """First approvals in encounter order with an ingredient, with all ingredients of the products found."""
    pair = ["noc_number", "noc_pi_din_product_id"]
    hit = ingredients.where(F.contains(F.upper("noc_pi_medic_ingr_name"), F.lit(term.upper()))).groupBy(*pair).agg(F.min("row_id").alias("first"))
    capped = hit.groupBy("noc_number").agg(F.min("first").alias("first")).orderBy("first").limit(most)
    nest = ingredients.join(hit, pair, "left_semi").join(F.broadcast(capped), "noc_number", "left_semi").groupBy(*pair).agg(F.array_join(F.array_sort(F.collect_set(F.upper("noc_pi_medic_ingr_name"))), "; ").alias("ingredients"))
    one = relational.first_rows(main, ["noc_number"], [F.col("row_id")]).select("noc_number", "noc_manufacturer_name", "noc_date")
    return nest.withColumnRenamed("noc_pi_din_product_id", "product_id").join(one, "noc_number", "left")


@query(f"""WITH {_TERMS}, hit AS (SELECT noc_number, noc_pi_din_product_id, min(row_id) AS first FROM api_medicinalingredient, t WHERE contains(upper(noc_pi_medic_ingr_name), n) GROUP BY ALL),
 capped AS (SELECT noc_number FROM (SELECT noc_number, min(first) AS f FROM hit GROUP BY 1) ORDER BY f LIMIT 200),
 m AS (SELECT noc_number, noc_pi_din_product_id AS product_id, array_to_string(list_sort(list(DISTINCT upper(noc_pi_medic_ingr_name))), '; ') AS ingredients FROM api_medicinalingredient SEMI JOIN hit USING (noc_number, noc_pi_din_product_id) SEMI JOIN capped USING (noc_number) GROUP BY 1, 2),
 one AS (SELECT noc_number, noc_manufacturer_name, noc_date FROM api_main QUALIFY row_number() OVER (PARTITION BY noc_number ORDER BY row_id) = 1)
 SELECT m.*, noc_manufacturer_name, noc_date FROM m LEFT JOIN one USING (noc_number)""")
def approval_search(spark: SparkSession, d: str) -> DataFrame:
    i = table(spark, d, "api_medicinalingredient")
    return search_approvals(i, table(spark, d, "api_main"), _term(i, "noc_pi_medic_ingr_name", 5))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT drug_code, brand_name, company_name, drug_identification_number AS din FROM drugproduct QUALIFY row_number() OVER (PARTITION BY drug_code ORDER BY last_update_date DESC NULLS LAST, row_id DESC) = 1),
 i AS (SELECT drug_code, string_agg(upper(ingredient_name), '; ' ORDER BY upper(ingredient_name), row_id) AS ingredients, count(*) AS parts FROM activeingredient WHERE ingredient_name IS NOT NULL GROUP BY 1),
 l AS (SELECT drug_code, count(*) AS labels FROM store_labeling GROUP BY 1)
 SELECT p.*, ingredients, coalesce(parts, 0) AS parts, coalesce(labels, 0) AS labels FROM p LEFT JOIN i USING (drug_code) LEFT JOIN l USING (drug_code)""")
def catalogue_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Latest record of a drug with its ingredients in order and its labels: children aggregated before the joins."""
    p = relational.first_rows(table(spark, d, "drugproduct"), ["drug_code"], [F.desc_nulls_last("last_update_date"), F.desc("row_id")]).select("drug_code", "brand_name", "company_name", F.col("drug_identification_number").alias("din"))
    name = F.struct(F.upper("ingredient_name").alias("n"), F.col("row_id"))
    i = table(spark, d, "activeingredient").where("ingredient_name IS NOT NULL").groupBy("drug_code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["n"]), "; ").alias("ingredients"), F.count("*").alias("parts"))
    n = table(spark, d, "store_labeling").groupBy("drug_code").agg(F.count("*").alias("labels"))
    return p.join(i, "drug_code", "left").join(n, "drug_code", "left").na.fill(0, ["parts", "labels"])


_P = "p AS (SELECT drug_identification_number AS din, brand_name, company_name FROM drugproduct WHERE drug_identification_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY drug_identification_number ORDER BY row_id DESC) = 1)"
_L = "l AS (SELECT din, color, shape FROM store_labeling WHERE din IS NOT NULL QUALIFY row_number() OVER (PARTITION BY din ORDER BY fetched_at DESC, row_id DESC) = 1)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "drugproduct").withColumn("din", F.col("drug_identification_number")).where("din IS NOT NULL")
    p = relational.first_rows(p, ["din"], [F.desc("row_id")]).select("din", "brand_name", "company_name")
    one = relational.first_rows(table(spark, d, "store_labeling").where("din IS NOT NULL"), ["din"], [F.desc("fetched_at"), F.desc("row_id")])
    return p, one.select("din", "color", "shape")


@query(f"WITH {_P}, {_L} SELECT p.din, brand_name, company_name, color, shape FROM p JOIN l USING (din)")
def mart_inner(spark: SparkSession, d: str) -> DataFrame:
    p, n = _sides(spark, d)
    return p.join(n, "din")


@query(f"WITH {_P}, {_L} SELECT coalesce(p.din, l.din) AS din, CASE WHEN p.din IS NULL THEN 'Not in DPD' ELSE brand_name END AS brand_name, CASE WHEN l.din IS NULL THEN 'No PM available' ELSE color END AS color FROM p FULL JOIN l ON p.din = l.din")
def mart_union(spark: SparkSession, d: str) -> DataFrame:
    """Full join: what a side lacks is a sentinel, what it has but leaves out stays null."""
    p, n = _sides(spark, d)
    both = p.withColumn("in_p", F.lit(True)).join(n.withColumn("in_l", F.lit(True)), "din", "full_outer")
    return both.select("din", F.when(F.col("in_p").isNull(), "Not in DPD").otherwise(F.col("brand_name")).alias("brand_name"), F.when(F.col("in_l").isNull(), "No PM available").otherwise(F.col("color")).alias("color"))


@query(f"WITH {_P}, {_L} SELECT din, company_name, 'no label' AS reason FROM p ANTI JOIN l USING (din)")
def exclusions(spark: SparkSession, d: str) -> DataFrame:
    p, n = _sides(spark, d)
    return p.join(n, "din", "left_anti").select("din", "company_name", F.lit("no label").alias("reason"))


@query(f"""WITH b AS (SELECT drug_id, {_DIN.format(c="din")} AS din, regexp_replace(patent_number, '\\D', '', 'g') AS pn, min(line_no) AS first FROM patent_bulk WHERE patent_number IS NOT NULL GROUP BY ALL),
 j AS (SELECT b.din, pn, min(first) AS first FROM b JOIN (SELECT DISTINCT drug_code FROM drugproduct) p ON b.drug_id = p.drug_code WHERE b.din IS NOT NULL AND b.din <> '00000000' GROUP BY ALL)
 SELECT din, string_agg(pn, ',' ORDER BY first, pn) AS patents FROM j GROUP BY din""")
def patents_by_din(spark: SparkSession, d: str) -> DataFrame:
    """Patents of each DIN in file order, each once, of drugs that the catalogue has."""
    rows = table(spark, d, "patent_bulk").where("patent_number IS NOT NULL").select(F.col("drug_id").alias("drug_code"), normalize_din(F.col("din")).alias("din"), F.regexp_replace("patent_number", r"\D", "").alias("pn"), "line_no")
    known = rows.where("din IS NOT NULL AND din <> '00000000'").join(table(spark, d, "drugproduct").select("drug_code").distinct(), "drug_code", "left_semi")
    first = known.groupBy("din", "pn").agg(F.min("line_no").alias("first"))
    return first.groupBy("din").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "pn"))), lambda x: x["pn"]), ",").alias("patents"))


@query("""WITH a AS (SELECT DISTINCT lower(trim(ingredient_name)) AS a FROM activeingredient WHERE length(trim(ingredient_name)) > 0), b AS (SELECT DISTINCT lower(trim(noc_pi_medic_ingr_name)) AS b FROM api_medicinalingredient WHERE length(trim(noc_pi_medic_ingr_name)) > 0)
 SELECT a AS ingredient, b AS registered FROM a, b WHERE contains(a, b) OR contains(b, a)""")
def register_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names of which one holds the other: an equi-join on first characters instead of all pairs."""
    a = table(spark, d, "activeingredient").select(F.lower(F.trim("ingredient_name")).alias("a")).where("length(a) > 0").distinct()
    b = table(spark, d, "api_medicinalingredient").select(F.lower(F.trim("noc_pi_medic_ingr_name")).alias("b")).where("length(b) > 0").distinct()
    return relational.containment_pairs(a, b).select(F.col("a").alias("ingredient"), F.col("b").alias("registered"))


@query("""WITH a AS (SELECT drug_code, list(DISTINCT upper(trim(ingredient_name))) AS n FROM activeingredient WHERE ingredient_name IS NOT NULL GROUP BY 1),
 b AS (SELECT drug_code, list_distinct(flatten(list(list_transform(regexp_split_to_array(upper(active_ingredient), '\\s*;\\s*'), lambda x: trim(x))))) AS n FROM store_labeling WHERE active_ingredient IS NOT NULL GROUP BY 1),
 j AS (SELECT drug_code, array_to_string(list_sort(list_filter(a.n, lambda x: NOT list_contains(b.n, x))), '; ') AS only_a, array_to_string(list_sort(list_filter(b.n, lambda x: NOT list_contains(a.n, x))), '; ') AS only_b FROM a JOIN b USING (drug_code))
 SELECT * FROM j WHERE only_a <> '' OR only_b <> ''""")
def consistency_warnings(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "activeingredient").where("ingredient_name IS NOT NULL").groupBy("drug_code").agg(F.collect_set(F.upper(F.trim("ingredient_name"))).alias("names"))
    b = table(spark, d, "store_labeling").where("active_ingredient IS NOT NULL").groupBy("drug_code").agg(F.array_distinct(F.flatten(F.collect_list(F.transform(F.split(F.upper("active_ingredient"), r"\s*;\s*"), lambda x: F.trim(x))))).alias("names"))
    return dq.set_differences(a, b, "drug_code")


@query("""WITH s AS (SELECT din, list(DISTINCT patent_number ORDER BY patent_number) AS n FROM store_patents GROUP BY 1), l AS (SELECT din, list(DISTINCT color ORDER BY color) FILTER (color IS NOT NULL) AS c FROM store_labeling GROUP BY 1)
 SELECT coalesce(s.din, l.din) AS din, coalesce(array_to_string(n, ','), '') AS patents, coalesce(array_to_string(c, ','), '') AS colors FROM s FULL JOIN l ON s.din = l.din WHERE coalesce(s.din, l.din) IS NOT NULL""")
def master_records(spark: SparkSession, d: str) -> DataFrame:
    """All sources of a DIN in one row, by one shuffle of their union."""
    s = table(spark, d, "store_patents").select("din", "patent_number").where("din IS NOT NULL").distinct()
    n = table(spark, d, "store_labeling").select("din", "color").where("din IS NOT NULL").distinct()
    m = relational.master_rows("din", {"patents": s, "labels": n})
    return m.select("din", F.array_join(F.transform("patents", lambda x: x["patent_number"]), ",").alias("patents"), F.array_join(F.filter(F.transform("labels", lambda x: x["color"]), lambda x: x.isNotNull()), ",").alias("colors"))


@query("WITH last AS (SELECT din, max(fetched_at) AS last_fetched FROM store_patents GROUP BY 1) SELECT w.din, last_fetched FROM (SELECT DISTINCT din FROM store_labeling WHERE din IS NOT NULL) w LEFT JOIN last USING (din) WHERE last_fetched IS NULL OR last_fetched < TIMESTAMP '2025-06-01'")
def stale_dins(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "store_labeling").where("din IS NOT NULL")
    return relational.stale_keys(wanted, table(spark, d, "store_patents"), "din", "fetched_at", F.lit("2025-06-01").cast("timestamp_ntz"))


# --- aggregates -------------------------------------------------------------------------------------------------------

_MONEY = {m: f"sum(CAST({_AMOUNT.format(c=m + '_mat_2024_06')} AS DECIMAL(18,2)))::DOUBLE" for m in ("dollars", "units")}


def _metric(name: str) -> F.Column:
    return amount(F.col(f"{name}_mat_2024_06")).cast("decimal(18,2)")


@query(f"SELECT combined_molecule, product, manufacturer, strength, {_MONEY['dollars']} AS dollars, {_MONEY['units']} AS units, string_agg(row_id::VARCHAR, ', ' ORDER BY row_id) AS source_rows FROM old_extract WHERE snapshot_no = (SELECT max(snapshot_no) FROM old_extract) GROUP BY 1, 2, 3, 4")
def sales_collapsed(spark: SparkSession, d: str) -> DataFrame:
    rows = _last_delivery(spark, d)
    out = sales.collapse(rows, [F.col(c) for c in ("combined_molecule", "product", "manufacturer", "strength")], {"dollars": _metric("dollars"), "units": _metric("units")}, "row_id")
    return out.withColumns({m: F.col(m).cast("double") for m in ("dollars", "units")})


@query(f"SELECT channel, {', '.join(f'''coalesce(sum(CASE WHEN province = '{p}' THEN CAST({_AMOUNT.format(c='dollars_mat_2024_06')} AS DECIMAL(18,2)) END), 0)::DOUBLE AS {p.lower()}''' for p in ('ONTARIO', 'QUEBEC', 'ALBERTA'))} FROM old_extract GROUP BY 1")
def sales_pivot(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "old_extract").select("channel", F.lower("province").alias("province"), _metric("dollars").alias("x"))
    return rows.groupBy("channel").pivot("province", ["ontario", "quebec", "alberta"]).agg(F.coalesce(F.sum("x"), F.lit(0)).cast("double")).na.fill(0.0)


@query("""SELECT regexp_extract(column_name, '^(\\w+?)_mat_', 1) AS metric, max(regexp_extract(column_name, '_mat_(\\d{4})_\\d{2}$', 1) || '/' || regexp_extract(column_name, '_(\\d{2})$', 1)) AS latest
 FROM (DESCRIBE SELECT * FROM old_extract) WHERE regexp_matches(column_name, '^\\w+?_mat_\\d{4}_\\d{2}$') GROUP BY 1""")
def latest_periods(spark: SparkSession, d: str) -> DataFrame:
    """Latest period of each metric: the header of the extract is its only place."""
    import re

    found = [(m[1], f"{m[2]}/{m[3]}") for c in table(spark, d, "old_extract").columns if (m := re.fullmatch(r"(\w+?)_mat_(\d{4})_(\d{2})", c))]
    return spark.createDataFrame(found, "metric string, period string").groupBy("metric").agg(F.max("period").alias("latest"))


def _sum(m: str) -> str:
    return f"sum(CAST({_AMOUNT.format(c=m + '_mat_2024_06')} AS DECIMAL(18,2)))::DOUBLE AS {m}"


_QOQ = f"""ends AS (SELECT min(snapshot_no) AS a, max(snapshot_no) AS b FROM old_extract),
 o AS (SELECT combined_molecule, province, {_sum("dollars")}, {_sum("units")} FROM old_extract WHERE snapshot_no = (SELECT a FROM ends) AND combined_molecule IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2),
 n AS (SELECT combined_molecule, province, {_sum("dollars")}, {_sum("units")} FROM old_extract WHERE snapshot_no = (SELECT b FROM ends) AND combined_molecule IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT combined_molecule, province, coalesce(o.dollars, 0) AS od, coalesce(n.dollars, 0) AS nd, coalesce(o.units, 0) AS ou, coalesce(n.units, 0) AS nu FROM o FULL JOIN n USING (combined_molecule, province)),
 s AS (SELECT *, CASE WHEN NOT (od > 0 OR ou > 0) AND (nd > 0 OR nu > 0) THEN 'entrant' WHEN (od > 0 OR ou > 0) AND NOT (nd > 0 OR nu > 0) THEN 'exit'
   WHEN (od > 0 OR ou > 0) AND (nd > 0 OR nu > 0) AND ((abs(nd - od) >= 100000 AND (od = 0 OR abs(nd - od) >= 0.1 * od)) OR (abs(nu - ou) >= 1000 AND (ou = 0 OR abs(nu - ou) >= 0.1 * ou))) THEN 'move'
   WHEN (od > 0 OR ou > 0) AND (nd > 0 OR nu > 0) THEN 'steady' END AS signal FROM j)"""


def _deliveries(spark: SparkSession, d: str) -> tuple[int | None, int | None]:
    """The first and the last delivery there are."""
    return tuple(table(spark, d, "old_extract").agg(F.min("snapshot_no"), F.max("snapshot_no")).first())


def _last_delivery(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the last delivery, which a report is on."""
    return table(spark, d, "old_extract").where(F.col("snapshot_no") == F.lit(_deliveries(spark, d)[1]))


def _compared(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "old_extract").where("combined_molecule IS NOT NULL AND province IS NOT NULL")
    one = [sales.collapse(rows.where(F.col("snapshot_no") == F.lit(n)), [F.col("combined_molecule"), F.col("province")], {m: _metric(m) for m in ("dollars", "units")}).withColumns({m: F.col(m).cast("double") for m in ("dollars", "units")}) for n in _deliveries(spark, d)]
    return sales.compare_periods(one[0], one[1], ["combined_molecule", "province"], ["dollars", "units"])


@query(f"WITH {_QOQ} SELECT combined_molecule, province, od AS old_dollars, nd AS new_dollars, ou AS old_units, nu AS new_units FROM s WHERE signal = 'move'")
def period_moves(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).where("signal = 'move'").select("combined_molecule", "province", "old_dollars", "new_dollars", "old_units", "new_units")


@query(f"WITH {_QOQ} SELECT combined_molecule, province, signal, od AS old_dollars, nd AS new_dollars, sum(nd + od) OVER (PARTITION BY combined_molecule) AS group_total FROM s WHERE signal IN ('entrant', 'exit')")
def period_entrants_exits(spark: SparkSession, d: str) -> DataFrame:
    c = _compared(spark, d).where("signal IN ('entrant', 'exit')").withColumn("t", F.col("new_dollars") + F.col("old_dollars"))
    return sales.with_group_total(c, ["combined_molecule"], "t").select("combined_molecule", "province", "signal", "old_dollars", "new_dollars", "group_total")


@query(f"WITH {_QOQ} SELECT signal, count(*) AS identities FROM s WHERE signal IS NOT NULL GROUP BY 1")
def period_summary(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d).groupBy("signal").agg(F.count("*").alias("identities"))


@query(f"""SELECT din, count(*) FILTER (expiry > DATE '{AS_OF}') AS active, max(strftime(expiry, '%Y-%m-%d') || ' ' || pn) FILTER (expiry > DATE '{AS_OF}') AS best,
 CASE WHEN count(*) FILTER (expiry > DATE '{AS_OF}') = 0 THEN 'all patents expired' END AS state
 FROM (SELECT DISTINCT din, regexp_replace(patent_number, '\\D', '', 'g') AS pn, {_DATE.format(c="expiry_date")} AS expiry FROM store_patents WHERE din IS NOT NULL) GROUP BY din""")
def active_patents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "store_patents").where("din IS NOT NULL").select("din", F.regexp_replace("patent_number", r"\D", "").alias("pn"), any_date(F.col("expiry_date")).alias("expiry")).distinct()
    live = F.col("expiry") > F.lit(AS_OF).cast("date")
    out = rows.groupBy("din").agg(F.count_if(live).alias("active"), F.max(F.when(live, F.concat(F.date_format("expiry", "yyyy-MM-dd"), F.lit(" "), "pn"))).alias("best"))
    return out.withColumn("state", F.when(F.col("active") == 0, "all patents expired"))


@query("""WITH r AS (SELECT upper(trim(noc_manufacturer_name)) AS manufacturer, noc_date, noc_submission_class AS class, noc_on_submission_type AS t, row_id FROM api_main WHERE trim(noc_manufacturer_name) <> '')
 SELECT manufacturer, string_agg(coalesce(noc_date, ''), '|' ORDER BY noc_date NULLS FIRST, row_id) FILTER (contains(t, '(NDS)')) AS dates, string_agg(coalesce(class, ''), '|' ORDER BY noc_date NULLS FIRST, row_id) FILTER (contains(t, '(NDS)')) AS classes,
 max(noc_date) FILTER (contains(t, '(ANDS)')) AS latest_abbreviated, count(*) AS submissions FROM r GROUP BY 1""")
def approval_history(spark: SparkSession, d: str) -> DataFrame:
    """Dates and classes of new submissions in order, line for line, blanks kept; the latest abbreviated one."""
    r = table(spark, d, "api_main").where("trim(noc_manufacturer_name) <> ''").select(F.upper(F.trim("noc_manufacturer_name")).alias("manufacturer"), "noc_date", "noc_submission_class", "row_id", F.contains("noc_on_submission_type", F.lit("(NDS)")).alias("nds"), F.contains("noc_on_submission_type", F.lit("(ANDS)")).alias("ands"))
    row = F.struct("noc_date", "row_id", "noc_submission_class")
    listed = F.array_sort(F.collect_list(F.when(F.col("nds"), row)), lambda a, b: F.when(F.coalesce(a["noc_date"], F.lit("")) < F.coalesce(b["noc_date"], F.lit("")), -1).when(F.coalesce(a["noc_date"], F.lit("")) > F.coalesce(b["noc_date"], F.lit("")), 1).otherwise(F.sign(a["row_id"] - b["row_id"]).cast("int")))
    out = r.groupBy("manufacturer").agg(listed.alias("h"), F.max(F.when(F.col("ands"), F.col("noc_date"))).alias("latest_abbreviated"), F.count("*").alias("submissions"))
    join = lambda f: F.when(F.size("h") > 0, F.array_join(F.transform("h", lambda x: F.coalesce(x[f], F.lit(""))), "|"))
    return out.select("manufacturer", join("noc_date").alias("dates"), join("noc_submission_class").alias("classes"), "latest_abbreviated", "submissions")


_FILL = ["din", "pdf_url", "active_ingredient", "nonmedicinal_ingredients", "pack_size", "color", "shape", "size_mm", "weight", "ph"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(count(*) FILTER ({c} IS NOT NULL AND trim({c}) <> '') / greatest(count(*), 1)::DOUBLE, 6) AS fill_rate FROM store_labeling" for c in _FILL))
def label_fill_rates(spark: SparkSession, d: str) -> DataFrame:
    return relational.fill_rates(table(spark, d, "store_labeling").select(*_FILL))


_REAL = "({c} IS NOT NULL AND trim({c}) <> '' AND lower(trim({c})) NOT IN (" + ", ".join(repr(s) for s in N.SENTINELS) + "))"


@query(f"SELECT pack_style, count(*) AS n, count(*) FILTER ({_REAL.format(c='color')}) AS with_color, count(*) FILTER ({_REAL.format(c='ph')}) AS with_ph, bool_or({_REAL.format(c='size_mm')}) AS any_size FROM store_labeling GROUP BY 1")
def label_stages(spark: SparkSession, d: str) -> DataFrame:
    """Rows with real values per group, sentinels not counted."""
    real = lambda c: N.real_value(F.col(c))
    return table(spark, d, "store_labeling").groupBy("pack_style").agg(F.count("*").alias("n"), F.count_if(real("color")).alias("with_color"), F.count_if(real("ph")).alias("with_ph"), F.bool_or(real("size_mm")).alias("any_size"))


_R = lambda c: _REAL.format(c=c)
_CHECKS = {
    ("size_format", "size_mm", "ERROR"): f"{_R('size_mm')} AND NOT regexp_matches(size_mm, '^\\d+(\\.\\d+)?( x \\d+(\\.\\d+)?)*$')",
    ("size_range", "size_mm", "WARN"): f"{_R('size_mm')} AND len(list_filter(list_transform(regexp_extract_all(size_mm, '(\\d+(?:\\.\\d+)?)', 1), lambda x: x::DOUBLE), lambda x: x < 2 OR x > 30)) > 0",
    ("ph_format", "ph", "ERROR"): f"{_R('ph')} AND NOT regexp_matches(ph, '^\\d+(\\.\\d+)?(-\\d+(\\.\\d+)?)?$')",
    ("ph_range", "ph", "ERROR"): f"{_R('ph')} AND len(list_filter(list_transform(regexp_extract_all(ph, '(\\d+(?:\\.\\d+)?)', 1), lambda x: x::DOUBLE), lambda x: x > 14)) > 0",
    ("weight_unit", "weight", "WARN"): f"{_R('weight')} AND NOT regexp_matches(weight, '(?i)\\d\\s*(g|mg)$')",
    ("style_digit", "pack_style", "WARN"): f"{_R('pack_style')} AND regexp_matches(pack_style, '\\d|:')",
    ("color_blank", "color", "INFO"): f"color IS NOT NULL AND NOT {_R('color')}",
    ("shape_blank", "shape", "INFO"): f"shape IS NOT NULL AND NOT {_R('shape')}",
    ("pack_blank", "pack_size", "INFO"): f"pack_size IS NOT NULL AND NOT {_R('pack_size')}",
}
_FOUND = " UNION ALL ".join(f"SELECT row_id, '{i}' AS check_id, '{f}' AS field, '{s}' AS severity, {f} AS value FROM store_labeling WHERE {w}" for (i, f, s), w in _CHECKS.items())


@query(_FOUND)
def label_findings(spark: SparkSession, d: str) -> DataFrame:
    return dq.findings(table(spark, d, "store_labeling"), "row_id", dq.label_checks())


@query(f"SELECT check_id, count(*) FILTER (severity = 'ERROR') AS \"ERROR\", count(*) FILTER (severity = 'WARN') AS \"WARN\", count(*) FILTER (severity = 'INFO') AS \"INFO\" FROM ({_FOUND}) GROUP BY 1")
def label_findings_summary(spark: SparkSession, d: str) -> DataFrame:
    return dq.summary(label_findings(spark, d))


@query("""WITH i AS (SELECT drug_code, array_to_string(list_sort(list(DISTINCT upper(trim(ingredient_name)))), ' + ') AS key FROM activeingredient WHERE trim(ingredient_name) <> '' GROUP BY 1),
 a AS (SELECT noc_pi_din_product_id, array_to_string(list_sort(list(DISTINCT upper(trim(noc_pi_medic_ingr_name)))), ' + ') AS key FROM api_medicinalingredient WHERE trim(noc_pi_medic_ingr_name) <> '' GROUP BY 1),
 f AS (SELECT key, count(*) AS approvals FROM a GROUP BY 1),
 p AS (SELECT key, count(DISTINCT company_name) AS companies, count(DISTINCT d.drug_code) AS drugs, max(last_update_date) AS last_update FROM i JOIN drugproduct d USING (drug_code) GROUP BY 1)
 SELECT p.*, coalesce(approvals, 0) AS approvals FROM p LEFT JOIN f USING (key) WHERE companies > 1 AND drugs < 200""")
def product_screen(spark: SparkSession, d: str) -> DataFrame:
    """Products by ingredient set with companies, drugs and approvals, screened by numeric criteria."""
    def keyed(t: DataFrame, group: str, name: str) -> DataFrame:
        return t.where(F.trim(name) != "").groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim(name)))), " + ").alias("key"))

    i = keyed(table(spark, d, "activeingredient"), "drug_code", "ingredient_name")
    f = keyed(table(spark, d, "api_medicinalingredient"), "noc_pi_din_product_id", "noc_pi_medic_ingr_name").groupBy("key").agg(F.count("*").alias("approvals"))
    p = i.join(table(spark, d, "drugproduct"), "drug_code").groupBy("key").agg(F.count_distinct("company_name").alias("companies"), F.count_distinct("drug_code").alias("drugs"), F.max("last_update_date").alias("last_update"))
    chosen = criteria.parse_criteria([{"metric": "companies", "op": "above", "value": "1"}, {"metric": "drugs", "op": "below", "value": "200"}, {"metric": "", "op": "", "value": ""}], {"companies", "drugs"})
    return criteria.screen(p.join(f, "key", "left").na.fill(0, ["approvals"]), chosen)


@query(f"SELECT line_no, drug_id FROM (SELECT *, {_DATE.format(c='expiration_date')} AS e FROM patent_bulk) WHERE e IS NULL OR e < DATE '{AS_OF}'")
def date_filter(spark: SparkSession, d: str) -> DataFrame:
    """A missing date passes `less` and nothing else."""
    from datetime import date

    return table(spark, d, "patent_bulk").where(criteria.by_date(any_date(F.col("expiration_date")), "less", date.fromisoformat(AS_OF))).select("line_no", "drug_id")


# --- windows, sets, samples -------------------------------------------------------------------------------------------


@query("SELECT drug_code, row_id, brand_name FROM drugproduct QUALIFY row_number() OVER (PARTITION BY drug_code ORDER BY row_id) = 1")
def first_per_drug(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_rows(table(spark, d, "drugproduct"), ["drug_code"], [F.col("row_id")]).select("drug_code", "row_id", "brand_name")


@query("SELECT 'both' AS side, din FROM (SELECT din FROM store_patents INTERSECT SELECT din FROM store_labeling) UNION ALL SELECT 'patents', din FROM (SELECT din FROM store_patents EXCEPT SELECT din FROM store_labeling) UNION ALL SELECT 'labels', din FROM (SELECT din FROM store_labeling EXCEPT SELECT din FROM store_patents)")
def din_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "store_patents").select("din"), table(spark, d, "store_labeling").select("din")
    part = lambda n, x: x.select(F.lit(n).alias("side"), "din")
    return part("both", a.intersect(b)).union(part("patents", a.subtract(b))).union(part("labels", b.subtract(a)))


@query("SELECT 'store' AS source, row_id AS id, din, NULL AS drug_id FROM store_patents UNION ALL SELECT 'bulk', line_no, din, drug_id::VARCHAR FROM patent_bulk")
def stacked(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "store_patents").select(F.lit("store").alias("source"), F.col("row_id").alias("id"), "din")
    b = table(spark, d, "patent_bulk").select(F.lit("bulk").alias("source"), F.col("line_no").alias("id"), "din", F.col("drug_id").cast("string").alias("drug_id"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""WITH n AS (SELECT din, patent_number, filing_date FROM store_patents WHERE fetched_at >= TIMESTAMP '2025-06-01' QUALIFY row_number() OVER (PARTITION BY din, patent_number ORDER BY fetched_at DESC, row_id DESC) = 1),
 o AS (SELECT din, patent_number, filing_date FROM store_patents WHERE fetched_at < TIMESTAMP '2025-06-01' QUALIFY row_number() OVER (PARTITION BY din, patent_number ORDER BY fetched_at DESC, row_id DESC) = 1)
 SELECT * FROM o ANTI JOIN n USING (din, patent_number) UNION ALL SELECT * FROM n""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "store_patents")
    cut = F.lit("2025-06-01").cast("timestamp_ntz")
    one = lambda x: relational.first_rows(x, ["din", "patent_number"], [F.desc("fetched_at"), F.desc("row_id")]).select("din", "patent_number", "filing_date")
    return relational.upsert(one(t.where(F.col("fetched_at") < cut)), one(t.where(F.col("fetched_at") >= cut)), ["din", "patent_number"])


@query("SELECT nature, row_id FROM activeingredient QUALIFY row_number() OVER (PARTITION BY nature ORDER BY md5(row_id::VARCHAR), row_id) <= 8")
def label_sample(spark: SparkSession, d: str) -> DataFrame:
    return relational.stratified_sample(table(spark, d, "activeingredient"), "nature", "row_id", 8).select("nature", "row_id")


# --- job events -------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, count(*) OVER w AS done, round(100.0 * count(*) OVER w / count(*) OVER (PARTITION BY user_id), 1) AS percent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def job_progress(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    done = F.count("*").over(w)
    return table(spark, d, "events").select("user_id", "event_id", "event_type", done.alias("done"), F.round(F.lit(100.0) * done / F.count("*").over(Window.partitionBy("user_id")), 1).alias("percent"))


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def job_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    m = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("m")
    return rows.groupBy("user_id").agg(m).select("user_id", "m.event_id", "m.event_type", "m.ts")


@query("WITH c AS (SELECT max(ts) AS now FROM events) SELECT user_id, event_type, max(ts) AS stored FROM events GROUP BY 1, 2 HAVING max(ts) >= (SELECT now FROM c) - INTERVAL 7 DAY")
def cache_view(spark: SparkSession, d: str) -> DataFrame:
    """Entries that haven't expired: last write per key within the time to live."""
    e = table(spark, d, "events")
    oldest = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).cast("string")).first()[0]
    return e.groupBy("user_id", "event_type").agg(F.max("ts").alias("stored")).where(F.col("stored") >= F.lit(oldest).cast("timestamp_ntz"))



# --- matching and text; no SQL has these similarities -----------------------------------------------------------------


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    p = relational.first_rows(table(spark, d, "drugproduct"), ["drug_code"], [F.desc_nulls_last("last_update_date"), F.desc("row_id")])
    row = F.struct(F.upper("ingredient_name").alias("n"), F.concat_ws(" ", F.when(~F.col("strength").rlike("[A-Za-z%]"), F.concat_ws(" ", F.trim("strength"), F.trim("strength_unit"))).otherwise(F.trim("strength"))).alias("s"))
    i = table(spark, d, "activeingredient").where("ingredient_name IS NOT NULL").groupBy("drug_code").agg(F.array_sort(F.collect_set(row)).alias("r"))
    cols = i.select("drug_code", F.array_join(F.transform("r", lambda x: x["n"]), "; ").alias("ingredient"), F.array_join(F.transform("r", lambda x: x["s"]), "; ").alias("strength"))
    return p.join(cols, "drug_code", "left").select(F.col("drug_identification_number").alias("din"), "ingredient", "brand_name", F.col("company_name").alias("company"), "strength", F.lit("marketed").alias("status"))


@query()
def line_matches(spark: SparkSession, d: str) -> DataFrame:
    """Sales groups of the last snapshot matched to catalogue products, with the confidence of each match."""
    sold = _last_delivery(spark, d).select("combined_molecule", "product", "manufacturer", "strength").distinct()
    found = matcher.match_sales(sold, _catalogue(spark, d))
    return found.withColumn("confidence", matcher.confidence(F.col("status"), F.col("top_score")))


@query()
def match_summary(spark: SparkSession, d: str) -> DataFrame:
    return line_matches(spark, d).groupBy("status", "confidence").agg(F.count("*").alias("n"), F.round(F.avg("top_score"), 1).alias("mean_score"))


@query(r"""SELECT DISTINCT company_name, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(coalesce(company_name, ''))), '[^\x00-\x7F]', '', 'g'), '[.,/&]', '', 'g'),
 '\b(?:incorporated|inc|limited|limitee|ltee|ltd\b|llc|llp|ulc|corporation|corp|co\b|sa\b|ag\b|gmbh|plc|sencrl|senc|sec\b|pharmaceuticals|pharmaceutical|pharma\b|therapeutics|laboratoires|laboratoire|laboratories|laboratory|labs\b|lab\b|healthcare|health|canada|a division of|division|serono|consumer)', ' ', 'g'), '\s+', ' ', 'g')) AS company FROM drugproduct""".replace("\\\\", "\\"))
def company_cores(spark: SparkSession, d: str) -> DataFrame:
    """Distinct company names only are folded; the rest joins back."""
    names = table(spark, d, "drugproduct").select("company_name").distinct()
    return names.withColumn("company", company_core_udf("company_name"))


@query()
def strength_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "old_extract").select("strength").distinct().withColumn("strength_key", strength_key_udf("strength"))


@query()
def monograph_fields(spark: SparkSession, d: str) -> DataFrame:
    return monograph.page_fields(table(spark, d, "piqray_pages"))


@query()
def monograph_sections(spark: SparkSession, d: str) -> DataFrame:
    return monograph.page_sections(table(spark, d, "piqray_pages"), r"^\d* ?(?:PACKAGING|Packaging|.*COMPOSITION AND PACKAGING)\s*$", r"^\d{1,2} [A-Z][A-Z ,]+$|^(?:Description|Clinical trials)$")


_PM = ["nonmedicinal_ingredients", "pack_size", "pack_style", "color", "shape", "size_mm", "weight", "ph"]
_ANY_REAL = "(" + " OR ".join(_R(c) for c in _PM) + ")"
_ANY_NONE = "(" + " OR ".join(f"coalesce(lower(trim({c})) = 'no pm available', false)" for c in _PM) + ")"
_COHERENT = {
    ("mixed_sentinel", "pdf_url", "ERROR"): f"{_ANY_REAL} AND {_ANY_NONE}",
    ("ingredient_blank", "active_ingredient", "ERROR"): f"drug_code IS NOT NULL AND NOT {_R('active_ingredient')}",
    ("no_appearance", "color", "WARN"): f"{_R('nonmedicinal_ingredients')} AND NOT {_R('color')} AND NOT {_R('shape')}",
    ("weight_without_size", "size_mm", "WARN"): f"{_R('weight')} AND NOT {_R('size_mm')}",
    ("size_without_weight", "weight", "WARN"): f"{_R('size_mm')} AND NOT {_R('weight')}",
}


@query(" UNION ALL ".join(f"SELECT row_id, '{i}' AS check_id, '{f}' AS field, '{s}' AS severity, {f} AS value FROM store_labeling WHERE {w}" for (i, f, s), w in _COHERENT.items()))
def label_coherence(spark: SparkSession, d: str) -> DataFrame:
    return dq.findings(table(spark, d, "store_labeling"), "row_id", dq.coherence_checks())


@query(
    """SELECT row_id, 'class_missing' AS check_id, 'noc_therapeutic_class' AS field, 'INFO' AS severity, noc_therapeutic_class AS value FROM api_main WHERE (noc_therapeutic_class IS NULL OR trim(noc_therapeutic_class) = '') AND noc_date IS NOT NULL AND trim(noc_date) <> '' AND trim(noc_on_submission_type) <> ''
 UNION ALL SELECT row_id, 'type_unknown', 'noc_on_submission_type', 'ERROR', noc_on_submission_type FROM api_main WHERE trim(noc_on_submission_type) <> '' AND trim(noc_on_submission_type) NOT IN ('NDS', 'ANDS', 'New Drug Submission (NDS)', 'Abbreviated New Drug Submission (ANDS)')
 UNION ALL SELECT row_id, 'supplement_flag', 'noc_is_suppliment', 'WARN', noc_is_suppliment FROM api_main WHERE (coalesce(noc_is_suppliment, '') = 'Y') <> coalesce(contains(lower(noc_on_submission_type), 'supplement'), false)"""
)
def approval_findings(spark: SparkSession, d: str) -> DataFrame:
    kind = F.trim("noc_on_submission_type")
    checks = [
        ("class_missing", "noc_therapeutic_class", "INFO", ~(F.trim(text("noc_therapeutic_class")) != "") & (F.trim(text("noc_date")) != "") & (kind != "")),
        ("type_unknown", "noc_on_submission_type", "ERROR", (kind != "") & ~kind.isin("NDS", "ANDS", "New Drug Submission (NDS)", "Abbreviated New Drug Submission (ANDS)")),
        ("supplement_flag", "noc_is_suppliment", "WARN", (text("noc_is_suppliment") == "Y") != F.coalesce(F.contains(F.lower("noc_on_submission_type"), F.lit("supplement")), F.lit(False))),
    ]
    return dq.findings(table(spark, d, "api_main"), "row_id", checks)


@query("SELECT row_id, 'number_length' AS check_id, 'patent_number' AS field, 'WARN' AS severity, patent_number AS value FROM store_patents WHERE length(regexp_replace(regexp_replace(trim(patent_number), '(?i)^ca\\s*', ''), '[,\\s]+', '', 'g')) <> 7 UNION ALL SELECT row_id, 'no_detail', 'detail_url', 'INFO', detail_url FROM store_patents WHERE detail_url IS NULL AND patent_number IS NOT NULL")
def patent_findings(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_replace(F.regexp_replace(F.trim("patent_number"), r"(?i)^ca\s*", ""), r"[,\s]+", "")
    return dq.findings(table(spark, d, "store_patents"), "row_id", [("number_length", "patent_number", "WARN", F.length(n) != 7), ("no_detail", "detail_url", "INFO", F.col("detail_url").isNull() & F.col("patent_number").isNotNull())])


@query()
def match_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every match weighed anew against its rivals, the suspicious ones marked."""
    sold = _last_delivery(spark, d).select("combined_molecule", "product", "manufacturer", "strength").distinct()
    catalogue = _catalogue(spark, d)
    return audit.audit_matches(matcher.match_sales(sold, catalogue).where("status = 'matched'"), sold, catalogue)

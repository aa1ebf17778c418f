"""Queries of report orders, stamps, summaries and normalisers, with the same results in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions import names as N
from rxloom.functions.similarity import company_core_udf
from rxloom.functions.text import any_date, normalize_din
from rxloom.operators import audit, matcher, relational, reports, sales
from rxloom.plans import market
from rxloom.plans.core_problems import _AMOUNT, _DATE
from rxloom.sources.tables import table

AS_OF = dt.date(2025, 1, 1)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# --- normalisers ------------------------------------------------------------------------------------------------------


@query("""SELECT row_id, CASE WHEN upper(trim(drug_identification_number)) IN ('N/A', 'NA', 'NOT APPLICABLE') OR trim(drug_identification_number) = '' THEN NULL ELSE trim(drug_identification_number) END AS approval_din,
 lower(trim(coalesce(drug_identification_number, ''))) IN ('', 'not applicable', 'n/a', 'na', 'none') AS excluded, regexp_replace(upper(trim(regexp_replace(brand_name, '\\s+', ' ', 'g'))), ' +', ' ', 'g') AS brand_key,
 TRY_CAST(nullif(regexp_extract(last_update_date, '(\\d{4}-\\d{1,2}-\\d{1,2})', 1), '') AS DATE) AS first_date FROM drugproduct""")
def catalogue_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Product numbers that say there is none, comparison form of a brand, first date of a text."""
    t = table(spark, d, "drugproduct")
    brand = F.upper(F.trim(F.regexp_replace("brand_name", r"\s+", " ")))
    return t.select("row_id", N.approval_din(F.col("drug_identification_number")).alias("approval_din"), N.excluded_din(F.col("drug_identification_number")).alias("excluded"), brand.alias("brand_key"), N.first_iso_date(F.col("last_update_date")).alias("first_date"))


_STRENGTH = "trim(strength)"
_LEAD = f"regexp_extract({_STRENGTH}, '^(\\d+(?:\\.\\d+)?)', 1)"


@query(f"""SELECT row_id, CASE WHEN {_LEAD} = '' THEN {_STRENGTH} ELSE trim(concat_ws(' ', regexp_replace(regexp_replace({_LEAD}, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), trim(regexp_replace({_STRENGTH}, '^\\d+(?:\\.\\d+)?\\s*', '')))) END AS strength,
 CASE WHEN trim(coalesce(strength, '')) <> '' AND trim(coalesce(strength_unit, '')) <> '' THEN ingredient_name || ' ' || trim(strength) || ' ' || trim(strength_unit) ELSE ingredient_name END AS label,
 coalesce(CASE WHEN isnan(TRY_CAST(trim(strength) AS DOUBLE)) THEN 0.0 ELSE TRY_CAST(trim(strength) AS DOUBLE) END, 0.0) AS number FROM activeingredient WHERE ingredient_name IS NOT NULL""")
def strengths_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Strengths without idle zeros, `NAME STRENGTH UNIT`, and a number or 0."""
    t = table(spark, d, "activeingredient").where("ingredient_name IS NOT NULL")
    return t.select("row_id", N.trimmed_strength(F.col("strength")).alias("strength"), N.named_strength(F.col("ingredient_name"), F.col("strength"), F.col("strength_unit")).alias("label"), N.number_or_zero(F.col("strength")).alias("number"))


@query("SELECT row_id, noc_date, noc_manufacturer_name FROM api_main WHERE contains(regexp_replace(lower(trim(noc_therapeutic_class)), '\\s+', ' ', 'g'), 'lipid mod')")
def class_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose class holds the words asked for, however they are spaced."""
    hold = F.contains(F.regexp_replace(F.lower(F.trim("noc_therapeutic_class")), r"\s+", " "), F.lit("lipid mod"))
    return table(spark, d, "api_main").where(hold).select("row_id", "noc_date", "noc_manufacturer_name")


@query(f"SELECT line_no, din, patent_number FROM patent_bulk WHERE NOT coalesce({_DATE.format(c='expiration_date')} < DATE '{AS_OF}', false)")
def patents_to_fetch(spark: SparkSession, d: str) -> DataFrame:
    """What needs no fetch goes before anything costly: patents that have expired."""
    expired = F.coalesce(any_date(F.col("expiration_date")) < F.lit(AS_OF), F.lit(False))
    return table(spark, d, "patent_bulk").where(~expired).select("line_no", "din", "patent_number")


# --- sources ----------------------------------------------------------------------------------------------------------


@query("WITH one AS (SELECT min(drug_identification_number) AS din FROM drugproduct) SELECT p.row_id, p.drug_code, p.brand_name, i.n AS ingredients FROM drugproduct p JOIN one ON p.drug_identification_number = one.din LEFT JOIN (SELECT drug_code, count(*) AS n FROM activeingredient GROUP BY 1) i USING (drug_code)")
def catalogue_by_din(spark: SparkSession, d: str) -> DataFrame:
    """Records of one product number, here the least there is; the filter reaches the scan."""
    p = table(spark, d, "drugproduct")
    din = p.agg(F.min("drug_identification_number")).first()[0]
    n = table(spark, d, "activeingredient").groupBy("drug_code").agg(F.count("*").alias("ingredients"))
    return p.where(F.col("drug_identification_number") == F.lit(din)).select("row_id", "drug_code", "brand_name").join(n, "drug_code", "left").select("row_id", "drug_code", "brand_name", "ingredients")


_FILED = """f AS (SELECT i.noc_pi_medic_ingr_name AS medicinal_ingredient, CASE WHEN trim(m.noc_manufacturer_name) = 'Not available' THEN NULL ELSE m.noc_manufacturer_name END AS company, m.noc_therapeutic_class AS therapeutic_area, substr(m.noc_date, 1, 7) AS year_month, i.row_id
 FROM api_medicinalingredient i JOIN (SELECT * FROM api_main QUALIFY row_number() OVER (PARTITION BY noc_number ORDER BY row_id) = 1) m USING (noc_number))"""


def _filings(spark: SparkSession, d: str) -> DataFrame:
    m = relational.first_rows(table(spark, d, "api_main"), ["noc_number"], [F.col("row_id")]).select("noc_number", F.when(F.trim("noc_manufacturer_name") != "Not available", F.col("noc_manufacturer_name")).alias("company"), F.col("noc_therapeutic_class").alias("therapeutic_area"), F.substring("noc_date", 1, 7).alias("year_month"))
    return table(spark, d, "api_medicinalingredient").select("noc_number", F.col("noc_pi_medic_ingr_name").alias("medicinal_ingredient"), "row_id").join(m, "noc_number")


@query(f"WITH {_FILED}, t AS (SELECT lower(substr(min(noc_pi_medic_ingr_name), 1, 4)) AS q FROM api_medicinalingredient) SELECT medicinal_ingredient, company, therapeutic_area, year_month FROM f, t WHERE contains(lower(medicinal_ingredient), q) QUALIFY row_number() OVER (PARTITION BY medicinal_ingredient, company, year_month ORDER BY row_id) = 1")
def filings_search(spark: SparkSession, d: str) -> DataFrame:
    """Filings of an ingredient, each (ingredient, company, month) once; here the first letters of the first name there is."""
    q = (table(spark, d, "api_medicinalingredient").agg(F.min("noc_pi_medic_ingr_name")).first()[0] or "")[:4].lower()
    hit = _filings(spark, d).where(F.contains(F.lower("medicinal_ingredient"), F.lit(q)))
    return relational.first_rows(hit, ["medicinal_ingredient", "company", "year_month"], [F.col("row_id")]).select("medicinal_ingredient", "company", "therapeutic_area", "year_month")


@query(f"WITH {_FILED} SELECT medicinal_ingredient, company, therapeutic_area, year_month FROM f")
def filings_all(spark: SparkSession, d: str) -> DataFrame:
    return _filings(spark, d).select("medicinal_ingredient", "company", "therapeutic_area", "year_month")


@query("WITH t AS (SELECT lower(substr(min(ingredient_name), 1, 5)) AS q FROM activeingredient), c AS (SELECT DISTINCT drug_code FROM activeingredient, t WHERE contains(lower(ingredient_name), q)) SELECT DISTINCT drug_code, drug_identification_number AS din, brand_name FROM drugproduct SEMI JOIN c USING (drug_code) WHERE drug_identification_number IS NOT NULL")
def dins_by_ingredient(spark: SparkSession, d: str) -> DataFrame:
    """Product numbers and brands of the codes with an ingredient; here the first letters of the first name there is."""
    a = table(spark, d, "activeingredient")
    q = (a.agg(F.min("ingredient_name")).first()[0] or "")[:5].lower()
    codes = a.where(F.contains(F.lower("ingredient_name"), F.lit(q))).select("drug_code").distinct()
    return table(spark, d, "drugproduct").where("drug_identification_number IS NOT NULL").join(codes, "drug_code", "left_semi").select("drug_code", F.col("drug_identification_number").alias("din"), "brand_name").distinct()


# --- joins ------------------------------------------------------------------------------------------------------------

_SALT = "'hydrochloride', 'hcl', 'hydrobromide', 'sulfate', 'sulphate', 'mesylate', 'besylate', 'maleate', 'fumarate', 'succinate', 'tartrate', 'acetate', 'sodium', 'potassium', 'calcium', 'magnesium', 'dihydrate', 'monohydrate', 'usp', 'bp', 'ep'"
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{c}}), '([a-z]{{{{3,}}}})', 1), lambda w: w NOT IN ({_SALT}))))"


@query(f"""WITH p AS (SELECT drug_code, string_agg(DISTINCT upper(trim(ingredient_name)), ' ') AS names FROM activeingredient WHERE trim(ingredient_name) <> '' GROUP BY 1),
 f AS (SELECT {_TOKENS.format(c="noc_pi_medic_ingr_name")} AS t, count(*) AS filings FROM api_medicinalingredient WHERE noc_pi_medic_ingr_name IS NOT NULL GROUP BY 1)
 SELECT drug_code, coalesce(filings, 0) AS filings FROM p LEFT JOIN f ON {_TOKENS.format(c="names")} = t AND len(t) > 0""")
def product_filings(spark: SparkSession, d: str) -> DataFrame:
    """Filings of each drug by the set of words of its molecules."""
    p = table(spark, d, "activeingredient").where("trim(ingredient_name) <> ''").groupBy("drug_code").agg(F.array_join(F.collect_set(F.upper(F.trim("ingredient_name"))), " ").alias("names"))
    f = table(spark, d, "api_medicinalingredient")
    return reports.filings_of(p, f, N.molecule_tokens(F.col("names")), N.molecule_tokens(F.col("noc_pi_medic_ingr_name"))).select("drug_code", "filings")


@query("""SELECT row_id, din, CASE WHEN row_number() OVER (PARTITION BY din ORDER BY row_id) = 1 THEN n END AS patents FROM store_labeling LEFT JOIN (SELECT din, count(*) AS n FROM store_patents WHERE din IS NOT NULL GROUP BY 1) USING (din) WHERE din IS NOT NULL""")
def metrics_stamped(spark: SparkSession, d: str) -> DataFrame:
    """A metric of each product on its first row only."""
    sheet = table(spark, d, "store_labeling").where("din IS NOT NULL").select("row_id", "din")
    found = table(spark, d, "store_patents").where("din IS NOT NULL").select("din", F.lit(1).cast("long").alias("patents"))
    return reports.stamped(sheet, found, "din", [F.col("row_id")], ["patents"])


@query("""WITH l AS (SELECT din, color, shape FROM store_labeling WHERE din IS NOT NULL QUALIFY row_number() OVER (PARTITION BY din ORDER BY fetched_at DESC, row_id DESC) = 1),
 s AS (SELECT drug_identification_number AS din, brand_name, NULL::VARCHAR AS color, descriptor AS shape FROM drugproduct WHERE drug_identification_number IS NOT NULL), c AS (SELECT DISTINCT din FROM store_patents WHERE din IS NOT NULL)
 SELECT s.din, brand_name, CASE WHEN l.din IS NOT NULL AND c.din IS NOT NULL THEN l.color ELSE s.color END AS color, CASE WHEN l.din IS NOT NULL AND c.din IS NOT NULL THEN l.shape ELSE s.shape END AS shape FROM s LEFT JOIN l USING (din) LEFT JOIN c USING (din)""")
def survivors_patched(spark: SparkSession, d: str) -> DataFrame:
    """Label fields of the products that a screen left, here those with patents; the others keep what they have."""
    labels = relational.first_rows(table(spark, d, "store_labeling").where("din IS NOT NULL"), ["din"], [F.desc("fetched_at"), F.desc("row_id")])
    sheet = table(spark, d, "drugproduct").where("drug_identification_number IS NOT NULL").select(F.col("drug_identification_number").alias("din"), "brand_name", F.lit(None).cast("string").alias("color"), F.col("descriptor").alias("shape"))
    return reports.patched(sheet, labels, table(spark, d, "store_patents").where("din IS NOT NULL"), ["color", "shape"])


@query("SELECT drug_identification_number AS din, row_id, brand_name FROM drugproduct WHERE drug_identification_number IN (SELECT din FROM store_labeling WHERE color = 'white') ORDER BY din, row_id")
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the products that qualify, here the white ones, in order of their number."""
    chosen = table(spark, d, "store_labeling").where("color = 'white'").select("din").distinct()
    return table(spark, d, "drugproduct").select(F.col("drug_identification_number").alias("din"), "row_id", "brand_name").join(chosen, "din", "left_semi").orderBy("din", "row_id")


@query("WITH e AS (SELECT DISTINCT drug_identification_number AS din FROM drugproduct WHERE drug_identification_number IS NOT NULL) SELECT count(*) AS expected, count(*) FILTER (l.din IS NULL) AS missed, round(count(*) FILTER (l.din IS NULL) / count(*)::DOUBLE, 6) AS missed_rate FROM e LEFT JOIN (SELECT DISTINCT din FROM store_labeling) l USING (din)")
def delivery_completeness(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "drugproduct").select(F.col("drug_identification_number").alias("din"))
    return reports.completeness(e, table(spark, d, "store_labeling"), "din")


@query(f"""WITH b AS (SELECT {market._DIN.format(c="din")} AS din, regexp_replace(patent_number, '\\D', '', 'g') AS pn FROM patent_bulk WHERE patent_number IS NOT NULL), s AS (SELECT din, regexp_replace(patent_number, '\\D', '', 'g') AS pn FROM store_patents WHERE patent_number IS NOT NULL),
 g AS (SELECT din, array_to_string(list_sort(list(DISTINCT pn)), ',') AS patents FROM b WHERE din IS NOT NULL GROUP BY 1), h AS (SELECT din, array_to_string(list_sort(list(DISTINCT pn)), ',') AS patents FROM s WHERE din IS NOT NULL GROUP BY 1)
 SELECT DISTINCT l.din, coalesce(g.patents, h.patents) AS patents, CASE WHEN g.din IS NOT NULL THEN 'bulk' WHEN h.din IS NOT NULL THEN 'store' END AS origin FROM store_labeling l LEFT JOIN g USING (din) LEFT JOIN h ON l.din = h.din WHERE l.din IS NOT NULL""")
def patents_of_labels(spark: SparkSession, d: str) -> DataFrame:
    """Patents of each product from the bulk file, or else from the store."""
    def side(t: DataFrame, din, n: str) -> DataFrame:
        rows = t.where("patent_number IS NOT NULL").select(din.alias("din"), F.regexp_replace("patent_number", r"\D", "").alias("pn")).where("din IS NOT NULL")
        return rows.groupBy("din").agg(F.array_join(F.array_sort(F.collect_set("pn")), ",").alias(n))

    g = side(table(spark, d, "patent_bulk"), normalize_din(F.col("din")), "g")
    h = side(table(spark, d, "store_patents"), F.col("din"), "h")
    both = table(spark, d, "store_labeling").where("din IS NOT NULL").select("din").distinct().join(g, "din", "left").join(h, "din", "left")
    return both.select("din", F.coalesce("g", "h").alias("patents"), F.when(F.col("g").isNotNull(), "bulk").when(F.col("h").isNotNull(), "store").alias("origin"))


# --- aggregates and windows -------------------------------------------------------------------------------------------


@query("SELECT 'labels' AS store, count(*) AS n, max(fetched_at) AS latest, date_diff('day', max(fetched_at)::DATE, DATE '2026-01-01')::INTEGER AS age_days FROM store_labeling UNION ALL SELECT 'patents', count(*), max(fetched_at), date_diff('day', max(fetched_at)::DATE, DATE '2026-01-01')::INTEGER FROM store_patents")
def store_status(spark: SparkSession, d: str) -> DataFrame:
    stores = {"labels": (table(spark, d, "store_labeling"), "fetched_at"), "patents": (table(spark, d, "store_patents"), "fetched_at")}
    return reports.store_status(stores, F.lit(dt.date(2026, 1, 1)))




@query(f"""WITH s AS (SELECT din, pn, e FROM (SELECT din, regexp_replace(patent_number, '\\D', '', 'g') AS pn, {_DATE.format(c="expiry_date")} AS e, row_number() OVER (PARTITION BY din, regexp_replace(patent_number, '\\D', '', 'g') ORDER BY fetched_at DESC, row_id DESC) AS n FROM store_patents) WHERE n = 1),
 b AS (SELECT din, pn, e FROM (SELECT {market._DIN.format(c="din")} AS din, regexp_replace(patent_number, '\\D', '', 'g') AS pn, {_DATE.format(c="expiration_date")} AS e, row_number() OVER (PARTITION BY {market._DIN.format(c="din")}, regexp_replace(patent_number, '\\D', '', 'g') ORDER BY line_no DESC) AS n FROM patent_bulk) WHERE n = 1),
 j AS (SELECT coalesce(s.e < DATE '{AS_OF}', false) AS p, coalesce(b.e < DATE '{AS_OF}', false) AS a FROM s JOIN b USING (din, pn)),
 c AS (SELECT count(*) FILTER (p AND a) AS true_positive, count(*) FILTER (p AND NOT a) AS false_positive, count(*) FILTER (NOT p AND a) AS false_negative, count(*) FILTER (NOT p AND NOT a) AS true_negative FROM j)
 SELECT *, round(true_positive / (true_positive + false_positive)::DOUBLE, 6) AS "precision", round(true_positive / (true_positive + false_negative)::DOUBLE, 6) AS recall FROM c""")
def expiry_confusion(spark: SparkSession, d: str) -> DataFrame:
    """How the store's word that a patent has expired agrees with the bulk file's."""
    pn = F.regexp_replace("patent_number", r"\D", "").alias("pn")
    s = relational.first_rows(table(spark, d, "store_patents").select("din", pn, any_date(F.col("expiry_date")).alias("s"), "fetched_at", "row_id"), ["din", "pn"], [F.desc("fetched_at"), F.desc("row_id")])
    b = relational.first_rows(table(spark, d, "patent_bulk").select(normalize_din(F.col("din")).alias("din"), pn, any_date(F.col("expiration_date")).alias("b"), "line_no"), ["din", "pn"], [F.desc("line_no")])
    return reports.confusion(s.join(b, ["din", "pn"]), F.col("s") < F.lit(AS_OF), F.col("b") < F.lit(AS_OF))


@query("""WITH r AS (SELECT event_type, epoch(ts)::BIGINT AS s, epoch(ts)::BIGINT + ceil(abs(value))::BIGINT AS e, abs(value) AS t FROM events WHERE value IS NOT NULL),
 x AS (SELECT event_type, moment, sum(d) AS d FROM (SELECT event_type, s AS moment, 1 AS d FROM r UNION ALL SELECT event_type, e, -1 FROM r) GROUP BY 1, 2),
 p AS (SELECT event_type, max(n) AS peak FROM (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY moment ROWS UNBOUNDED PRECEDING) AS n FROM x) GROUP BY 1)
 SELECT event_type, count(*) AS calls, round(sum(t), 3) AS total, round(avg(t), 3) AS mean, round(max(t), 3) AS longest, any_value(peak)::BIGINT AS peak FROM r JOIN p USING (event_type) GROUP BY 1""")
def event_profile(spark: SparkSession, d: str) -> DataFrame:
    """Calls by type with their time, the value taken as seconds, and how many ran at once."""
    return reports.profile(table(spark, d, "events").where("value IS NOT NULL"), "event_type", F.col("ts"), F.abs("value"))


@query("SELECT row_id, row_number() OVER (ORDER BY din NULLS FIRST, row_id) + 1 AS position FROM store_labeling")
def rows_numbered(spark: SparkSession, d: str) -> DataFrame:
    """Place of each row in a report whose first row is below its header."""
    return reports.numbered(table(spark, d, "store_labeling").select("row_id", "din"), [F.col("din"), F.col("row_id")], first=2).select("row_id", "position")


@query("SELECT row_id, row_number() OVER (PARTITION BY active_ingredient ORDER BY din, row_id)::INTEGER AS row_no, row_number() OVER (PARTITION BY active_ingredient ORDER BY din, row_id) % 2 = 0 AS shaded FROM store_labeling WHERE din IS NOT NULL")
def rows_striped(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "store_labeling").where("din IS NOT NULL")
    return reports.striped(t, "active_ingredient", [F.col("din"), F.col("row_id")]).select("row_id", "row_no", "shaded")


# --- orders -----------------------------------------------------------------------------------------------------------


@query("SELECT din, row_id, pack_size FROM store_labeling WHERE din IS NOT NULL ORDER BY din, row_id")
def sheet_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "store_labeling").where("din IS NOT NULL").select("din", "row_id", "pack_size").orderBy("din", "row_id")


@query("SELECT active_ingredient, shape, count(*) AS n FROM store_labeling GROUP BY 1, 2 ORDER BY 1, 2")
def products_ordered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "store_labeling").groupBy("active_ingredient", "shape").agg(F.count("*").alias("n")).orderBy("active_ingredient", "shape")


def _two(spark: SparkSession, d: str) -> DataFrame:
    """The sales of the first and the last delivery there are."""
    rows = table(spark, d, "old_extract").where("combined_molecule IS NOT NULL AND province IS NOT NULL")
    ends = rows.agg(F.min("snapshot_no"), F.max("snapshot_no")).first()
    money = {m: market._metric(m) for m in ("dollars", "units")}
    one = [sales.collapse(rows.where(F.col("snapshot_no") == F.lit(n)), [F.col("combined_molecule"), F.col("province")], money).withColumns({m: F.col(m).cast("double") for m in money}) for n in ends]
    return sales.compare_periods(one[0], one[1], ["combined_molecule", "province"], ["dollars", "units"])


def _sum(m: str) -> str:
    return f"sum(CAST({_AMOUNT.format(c=m + '_mat_2024_06')} AS DECIMAL(18,2)))::DOUBLE AS {m}"


_ENDS = f"""x AS (SELECT min(snapshot_no) AS a, max(snapshot_no) AS b FROM old_extract WHERE combined_molecule IS NOT NULL AND province IS NOT NULL),
 g AS (SELECT snapshot_no, combined_molecule, province, {_sum("dollars")}, {_sum("units")} FROM old_extract WHERE combined_molecule IS NOT NULL AND province IS NOT NULL GROUP BY 1, 2, 3),
 j AS (SELECT coalesce(o.combined_molecule, n.combined_molecule) AS combined_molecule, coalesce(o.province, n.province) AS province, coalesce(o.dollars, 0) AS od, coalesce(n.dollars, 0) AS nd, coalesce(o.units, 0) AS ou, coalesce(n.units, 0) AS nu
   FROM (SELECT g.* FROM g, x WHERE snapshot_no = a) o FULL JOIN (SELECT g.* FROM g, x WHERE snapshot_no = b) n USING (combined_molecule, province))"""


@query(f"WITH {_ENDS} SELECT combined_molecule, province, nd AS new_dollars, sum(nd) OVER (PARTITION BY combined_molecule) AS group_total FROM j WHERE NOT (od > 0 OR ou > 0) AND (nd > 0 OR nu > 0) ORDER BY group_total DESC, 1, 3 DESC")
def entrants_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Entrants of the last delivery against the first, the largest molecules first."""
    e = _two(spark, d).where("signal = 'entrant'").select("combined_molecule", "province", "new_dollars")
    return reports.signal_order(e, ["combined_molecule"], "new_dollars")


@query(f"""WITH {_ENDS} SELECT combined_molecule, province, od AS old_dollars, nd AS new_dollars FROM j WHERE (od > 0 OR ou > 0) AND (nd > 0 OR nu > 0)
 AND ((abs(nd - od) >= 100000 AND (od = 0 OR abs(nd - od) >= 0.1 * od)) OR (abs(nu - ou) >= 1000 AND (ou = 0 OR abs(nu - ou) >= 0.1 * ou))) ORDER BY abs(nd - od) DESC, 1, 2""")
def moves_ordered(spark: SparkSession, d: str) -> DataFrame:
    m = _two(spark, d).where("signal = 'move'").select("combined_molecule", "province", "old_dollars", "new_dollars")
    return reports.move_order(m, "old_dollars", "new_dollars", ["combined_molecule", "province"])


@query("SELECT upper(trim(ingredient_name)) AS label, count(*) AS n FROM activeingredient WHERE trim(ingredient_name) <> '' GROUP BY 1 ORDER BY n DESC, label")
def groups_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Ingredients with what was asked for first, here the first in the alphabet, then the more frequent."""
    g = table(spark, d, "activeingredient").where("trim(ingredient_name) <> ''").groupBy(F.upper(F.trim("ingredient_name")).alias("label")).agg(F.count("*").alias("n"))
    return reports.group_order(g, g.agg(F.min("label")).first()[0] or "", "label", "n")


@query(f"SELECT din, patent_number, e AS expiry FROM (SELECT din, patent_number, row_id, {_DATE.format(c='expiry_date')} AS e FROM store_patents WHERE din IS NOT NULL) ORDER BY expiry DESC NULLS LAST, row_id")
def patents_ordered(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "store_patents").where("din IS NOT NULL").select("din", "patent_number", any_date(F.col("expiry_date")).alias("expiry"), "row_id")
    return t.orderBy(F.desc_nulls_last("expiry"), "row_id").drop("row_id")


@query("SELECT row_id, din, fetched_at FROM store_patents WHERE expiry_date IS NULL OR trim(expiry_date) = '' ORDER BY fetched_at DESC, row_id")
def discrepancies_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Entries to look into, the last logged first."""
    return table(spark, d, "store_patents").where("expiry_date IS NULL OR trim(expiry_date) = ''").select("row_id", "din", "fetched_at").orderBy(F.desc("fetched_at"), "row_id")


# --- matching; no SQL has these similarities ---------------------------------------------------------------------------


@query()
def match_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue products with the confidence of their best sales group."""
    order = [F.desc("top_score"), F.col("combined_molecule"), F.col("product"), F.col("manufacturer"), F.col("strength")]
    return reports.with_confidence(market._catalogue(spark, d).where("din IS NOT NULL").select("din", "brand_name", "company"), market.line_matches(spark, d), order)


@query()
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return match_confidence(spark, d).agg(F.count_if(F.col("match_confidence") == "low").alias("low"), F.count("*").alias("products"))


@query()
def suspicious_matches(spark: SparkSession, d: str) -> DataFrame:
    return reports.suspicious_order(market.match_audit(spark, d))


@query()
def value_audit(spark: SparkSession, d: str) -> DataFrame:
    """Which groups the stamped metrics of matched products come from: themselves, or a sum with a general label."""
    rows = table(spark, d, "old_extract")
    last = rows.agg(F.max("snapshot_no")).first()[0]
    keys = ["combined_molecule", "product", "manufacturer", "strength"]
    money = {m: market._metric(m) for m in ("dollars", "units")}
    sold = sales.collapse(rows.where(F.col("snapshot_no") == F.lit(last)), [F.col(k) for k in keys], money).withColumns({m: F.floor(m).cast("long") for m in money})
    catalogue = market._catalogue(spark, d)
    found = matcher.match_sales(sold, catalogue).where("status = 'matched'").select(*keys, "din")
    on = [found[k].eqNullSafe(sold[k]) for k in keys]
    sums = found.join(sold, on).select("din", "dollars", "units")
    stamped = reports.stamped(catalogue.where("din IS NOT NULL").select("din", "brand_name", "company", "strength", F.lit(0).alias("dollars"), F.lit(0).alias("units")), sums, "din", [F.col("brand_name")], list(money))
    return audit.audit_values(stamped, sold, list(money))


@query()
def companies_once(spark: SparkSession, d: str) -> DataFrame:
    """A costly form of a name, computed once for each spelling however many rows have it."""
    return reports.once_per_value(table(spark, d, "drugproduct").select("row_id", "company_name"), "company_name", "company", company_core_udf)

"""Queries of the checks of label, approval and patent fields, with the same results in SQL, and of the label cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from rxloom.functions.text import any_date
from rxloom.operators import grader, label_fields, register, relational
from rxloom.operators.findings import findings
from rxloom.plans.core_problems import _DATE
from rxloom.sources.tables import table

AS_OF = "2025-01-01"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register_(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register_


#: The SQL states its own constants, so that a wrong one on either side shows.
_NONE = "('', 'not in pm', 'no pm available', 'needs ocr / manual check', 'no noc record', 'n/a', 'na', 'none', 'not applicable', 'nan', 'not in dpd', 'n/a (uncoated)')"


def _real(c: str) -> str:
    return f"({c} IS NOT NULL AND lower(trim({c}::VARCHAR)) NOT IN {_NONE})"


def _union(key: str, table_: str, checks: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{i}' AS check_id, '{f}' AS field, '{s}' AS severity, {f}::VARCHAR AS value FROM {table_} WHERE coalesce({w}, false)" for i, f, s, w in checks)


_WORDS = r"\b(prefilled syringe|pre-filled syringe|auto-injector|auto injector|autoinjector|stick pack|blister pack|ampoule|ampule|ampul|vial|syringe|cartridge|blister|bottle|jar|tube|sachet|pouch|carton|bag|canister|inhaler|dropper|suppository|pen|kit)\b"
_ANYWHERE = _WORDS.replace(r"\b", "")
_NUMS = "list_transform(regexp_extract_all({c}, '(\\d+(?:\\.\\d+)?)', 1), lambda x: x::DOUBLE)"
_SIZED = r"(?i)^\d+(?:\.\d+)?(?:\s*[×x]\s*\d+(?:\.\d+)?)?\s*mm$|^\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*mm$"
_ACID = r"^\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?$"
_PHREAL = f"{_real('ph')} AND trim(ph) <> 'Not stated (pH-dependent solubility only)'"
_GRADES = [
    ("excipient_poison", "nonmedicinal_ingredients", "ERROR", f"{_real('nonmedicinal_ingredients')} AND regexp_matches(nonmedicinal_ingredients, '(?i)debossed|administration\\s+form|form\\s*/\\s*strength|administration\\s+strength|tablets?\\s+with\\s+[''\"]|strength\\s+and\\s+dosage|dosage\\s+form')"),
    ("excipient_heading", "nonmedicinal_ingredients", "ERROR", f"{_real('nonmedicinal_ingredients')} AND regexp_matches(trim(nonmedicinal_ingredients), ':\\s*$')"),
    ("style_colon", "pack_style", "ERROR", f"{_real('pack_style')} AND regexp_matches(trim(pack_style), ':\\s*$')"),
    ("style_heading", "pack_style", "ERROR", f"{_real('pack_style')} AND regexp_matches(trim(pack_style), '(?i)dosage strengths|^\\s*dosage\\s+form')"),
    ("style_vocabulary", "pack_style", "WARN", f"{_real('pack_style')} AND NOT regexp_matches(lower(pack_style), '{_ANYWHERE}')"),
    ("size_container", "pack_size", "ERROR", f"{_real('pack_size')} AND regexp_matches(lower(pack_size), '{_WORDS}')"),
    ("size_format", "size_mm", "ERROR", f"{_real('size_mm')} AND NOT regexp_matches(trim(size_mm), '{_SIZED}')"),
    ("size_range", "size_mm", "WARN", f"{_real('size_mm')} AND regexp_matches(trim(size_mm), '{_SIZED}') AND len(list_filter({_NUMS.format(c='size_mm')}, lambda x: x < 2 OR x > 30)) > 0"),
    ("ph_format", "ph", "ERROR", f"{_PHREAL} AND NOT regexp_matches(trim(ph), '{_ACID}')"),
    ("ph_range", "ph", "ERROR", f"{_PHREAL} AND regexp_matches(trim(ph), '{_ACID}') AND len(list_filter({_NUMS.format(c='ph')}, lambda x: x > 14)) > 0"),
    ("color_vocabulary", "color", "WARN", f"{_real('color')} AND len(list_filter(regexp_split_to_array(lower(trim(color)), '[,/]+'), lambda p: trim(p) <> '' AND NOT regexp_matches(p, '\\b(white|red|pink|orange|yellow|green|blue|purple|violet|brown|beige|grey|gray|black|cream|tan|teal|maroon|ivory)\\b'))) > 0"),
    ("shape_vocabulary", "shape", "WARN", f"{_real('shape')} AND NOT regexp_matches(lower(shape), 'round|oval|oblong|capsule[- ]shaped|caplet|biconvex|pentagonal|hexagonal|octagonal|triangular|diamond|shield|kidney|bean')"),
]


@query(_union("row_id", "store_labeling", _GRADES))
def label_grades(spark: SparkSession, d: str) -> DataFrame:
    """Invariants of single label fields, of the stages that ran."""
    checks = [*grader.excipient_checks("nonmedicinal_ingredients"), *grader.pack_checks(), *grader.descriptor_checks()]
    return grader.grade(table(spark, d, "store_labeling"), "row_id", {"LABELING": checks})


_APPROVALS = """(SELECT row_id, coalesce(nullif(trim(noc_date), ''), 'No NOC record') AS noc_date, coalesce(nullif(trim(noc_is_suppliment), ''), 'No NOC record') AS reason_for_supplement,
 coalesce(nullif(trim(noc_submission_class), ''), 'No NOC record') AS submission_class, coalesce(nullif(trim(noc_on_submission_type), ''), 'No NOC record') AS noc_submission_type, noc_therapeutic_class FROM api_main)"""
_FOUR = ("noc_date", "reason_for_supplement", "submission_class", "noc_submission_type")


@query(_union("row_id", _APPROVALS, [
    ("approval_mixed", "noc_date", "ERROR", "(" + " OR ".join(_real(c) for c in _FOUR) + ") AND (" + " OR ".join(f"{c} = 'No NOC record'" for c in _FOUR) + ")"),
    ("class_missing", "noc_therapeutic_class", "INFO", " AND ".join(_real(c) for c in _FOUR) + f" AND NOT {_real('noc_therapeutic_class')}"),
    ("submission_type", "noc_submission_type", "ERROR", f"{_real('noc_submission_type')} AND noc_submission_type NOT IN ('NDS', 'ANDS', 'New Drug Submission (NDS)', 'Abbreviated New Drug Submission (ANDS)')"),
]))
def approval_grades(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "api_main")
    mart = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(grader.NO_APPROVAL))
    rows = t.select("row_id", mart("noc_date").alias("noc_date"), mart("noc_is_suppliment").alias("reason_for_supplement"), mart("noc_submission_class").alias("submission_class"), mart("noc_on_submission_type").alias("noc_submission_type"), "noc_therapeutic_class")
    return grader.grade(rows, "row_id", {"NOC": grader.approval_checks()})


_COUNTED = "(SELECT din, count(*)::VARCHAR AS patent_count, max(CASE WHEN detail_url IS NOT NULL THEN patent_number END) AS patent_number FROM store_patents WHERE din IS NOT NULL GROUP BY din)"


@query(_union("din", _COUNTED, [
    ("count_without_number", "patent_count", "WARN", f"TRY_CAST(patent_count AS DOUBLE) >= 1 AND NOT {_real('patent_number')}"),
    ("number_length", "patent_number", "WARN", f"{_real('patent_number')} AND length(regexp_replace(regexp_replace(trim(patent_number), '(?i)^\\s*ca\\s*', ''), '[,\\s]+', '', 'g')) > 8"),
]))
def patent_grades(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "store_patents").where("din IS NOT NULL")
    mart = t.groupBy("din").agg(F.count("*").cast("string").alias("patent_count"), F.max(F.when(F.col("detail_url").isNotNull(), F.col("patent_number"))).alias("patent_number"))
    return findings(mart, "din", grader.patent_checks())


@query("SELECT CASE WHEN column_name LIKE '%\\_url' ESCAPE '\\' THEN 'column_url' ELSE 'column_page' END AS check_id, column_name AS field, 'ERROR' AS severity FROM (DESCRIBE SELECT * FROM store_labeling) WHERE column_name LIKE '%\\_url' ESCAPE '\\' OR column_name LIKE '%\\_page' ESCAPE '\\'")
def column_grades(spark: SparkSession, d: str) -> DataFrame:
    """Columns that a delivered mart must not have."""
    return spark.createDataFrame(grader.column_findings(table(spark, d, "store_labeling").columns), "check_id string, field string, severity string")


_DOC = ("nonmedicinal_ingredients", "pack_size", "pack_style", "ph", "color", "shape", "size_mm", "weight")
_MART = f"""(SELECT l.*, p.descriptor AS dosage_form, e.data_protection_ends FROM store_labeling l LEFT JOIN (SELECT drug_code, descriptor FROM drugproduct QUALIFY row_number() OVER (PARTITION BY drug_code ORDER BY row_id) = 1) p USING (drug_code)
 LEFT JOIN (SELECT din, max({_DATE.format(c="expiry_date")}) AS data_protection_ends FROM store_patents GROUP BY din) e ON l.din = e.din)"""
_SOME = "(" + " OR ".join(_real(c) for c in _DOC) + ")"


@query(_union("row_id", _MART, [
    ("ingredient_blank", "active_ingredient", "ERROR", f"drug_code IS NOT NULL AND NOT {_real('active_ingredient')}"),
    ("mixed_sentinel", "pdf_url", "ERROR", f"{_SOME} AND (" + " OR ".join(f"coalesce(trim({c}) = 'No PM available', false)" for c in _DOC) + ")"),
    ("no_appearance", "color", "WARN", f"{_real('nonmedicinal_ingredients')} AND NOT {_real('color')} AND NOT {_real('shape')}"),
    ("weight_without_size", "size_mm", "WARN", f"{_real('weight')} AND NOT {_real('size_mm')}"), ("size_without_weight", "weight", "WARN", f"{_real('size_mm')} AND NOT {_real('weight')}"),
    ("liquid_without_ph", "ph", "WARN", f"regexp_matches(lower(dosage_form), 'solution|liquid|injection|infusion|suspension|syrup|elixir|oral drops') AND NOT {_real('ph')}"),
    ("protection_past", "data_protection_ends", "ERROR", f"data_protection_ends < DATE '{AS_OF}'"),
]))
def mart_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Fields of a label row that contradict each other or the catalogue and patents joined to it."""
    form = relational.first_rows(table(spark, d, "drugproduct"), ["drug_code"], [F.col("row_id")]).select("drug_code", F.col("descriptor").alias("dosage_form"))
    ends = table(spark, d, "store_patents").groupBy("din").agg(F.max(any_date(F.col("expiry_date"))).alias("data_protection_ends"))
    mart = table(spark, d, "store_labeling").join(form, "drug_code", "left").join(ends, "din", "left")
    checks = grader.coherence_checks(F.lit(AS_OF).cast("date"))
    return grader.grade(mart, "row_id", {"LABELING": checks[:-1], "": checks[-1:]})


@query(f"""WITH k AS (SELECT drug_code, list(DISTINCT upper(trim(ingredient_name))) AS live FROM activeingredient WHERE trim(ingredient_name) <> '' GROUP BY 1),
 j AS (SELECT row_id, list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(upper(active_ingredient), '[;,]+'), lambda p: trim(p)), lambda p: p <> '' AND NOT list_contains(live, p)))) AS extra FROM store_labeling JOIN k USING (drug_code) WHERE {_real("active_ingredient")})
 SELECT row_id, 'invented' AS check_id, 'active_ingredient' AS field, 'ERROR' AS severity, array_to_string(extra, '; ') AS value FROM j WHERE len(extra) > 0""")
def invented_ingredients(spark: SparkSession, d: str) -> DataFrame:
    """Ingredients of labels that the catalogue doesn't have for the drug."""
    return grader.invented_values(table(spark, d, "store_labeling"), table(spark, d, "activeingredient"), "row_id", "active_ingredient", "drug_code", "ingredient_name")


@query(f"""WITH k AS (SELECT drug_code, upper(string_agg(brand_name || ' ' || coalesce(descriptor, ''), ' ' ORDER BY brand_name || ' ' || coalesce(descriptor, ''))) AS said FROM drugproduct WHERE brand_name IS NOT NULL GROUP BY 1),
 j AS (SELECT row_id, pack_size, pack_style, said FROM store_labeling JOIN k USING (drug_code))
 SELECT row_id, 'size_invented' AS check_id, 'pack_size' AS field, 'ERROR' AS severity, n AS value FROM (SELECT row_id, said, unnest(list_distinct(regexp_extract_all(pack_size, '(\\d+(?:\\.\\d+)?)', 1))) AS n FROM j WHERE {_real("pack_size")}) WHERE NOT contains(said, n) AND NOT contains(said, split_part(n, '.', 1))
 UNION ALL SELECT row_id, 'style_invented', 'pack_style', 'WARN', pack_style FROM j WHERE {_real("pack_style")} AND regexp_matches(lower(pack_style), '{_ANYWHERE}') AND NOT regexp_matches(lower(said), '{_ANYWHERE}')""")
def invented_packs(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and containers of packs that no product information of the drug names."""
    info = table(spark, d, "drugproduct").where("brand_name IS NOT NULL").select("drug_code", F.concat_ws(" ", "brand_name", F.coalesce("descriptor", F.lit(""))).alias("product_information"))
    return grader.invented_pack(table(spark, d, "store_labeling"), info, "row_id", "drug_code")


@query(f"""WITH p AS (SELECT row_id, drug_code, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(nonmedicinal_ingredients, '[,;]\\s*'), lambda x: trim(x)), lambda x: length(x) >= 3))) AS value FROM store_labeling WHERE {_real("nonmedicinal_ingredients")}),
 t AS (SELECT drug_code, text FROM piqray_pages WHERE text IS NOT NULL),
 s AS (SELECT drug_code, value, bool_or(contains(lower(text), lower(value))) AS found FROM (SELECT DISTINCT drug_code, value FROM p) JOIN t USING (drug_code) GROUP BY 1, 2)
 SELECT row_id, 'excipient_fabricated' AS check_id, 'nonmedicinal_ingredients' AS field, 'ERROR' AS severity, value FROM p JOIN s USING (drug_code, value) WHERE NOT found""")
def verbatim_excipients(spark: SparkSession, d: str) -> DataFrame:
    """Parts of ingredient lists that aren't word for word on the drug's monograph pages."""
    mart = table(spark, d, "store_labeling").withColumn("needs_ocr", F.lit(0))
    return grader.fabricated_excipients(mart, table(spark, d, "piqray_pages"), "row_id", "nonmedicinal_ingredients", "drug_code")


@query()
def fabricated_excipients(spark: SparkSession, d: str) -> DataFrame:
    """The same, but what was read by OCR may be nearly there."""
    return grader.fabricated_excipients(table(spark, d, "store_labeling"), table(spark, d, "piqray_pages"), "row_id", "nonmedicinal_ingredients", "drug_code")


_CLEAN = "regexp_replace(regexp_replace(trim(patent_number), '(?i)^\\s*ca\\s*', ''), '[,\\s]+', '', 'g')"


@query(f"""SELECT row_id, 'ghost_patent' AS check_id, 'patent_number' AS field, 'ERROR' AS severity, patent_number AS value FROM store_patents
 WHERE {_real("patent_number")} AND {_CLEAN} <> '' AND {_CLEAN} NOT IN (SELECT {_CLEAN} FROM patent_bulk WHERE trim(filing_date) <> '' AND {_CLEAN} <> '')""")
def ghost_patents(spark: SparkSession, d: str) -> DataFrame:
    return grader.ghost_patents(table(spark, d, "store_patents"), table(spark, d, "patent_bulk"), "row_id")


_RI = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '\\b\\d+(?:\\.\\d+)?\\s*(?:mg/ml|mg/l|mcg/ml|mcg|μg|ug|mmol|meq|mg|ml|iu|g|l)\\b', '', 'g'), '\\(.*?\\)', '', 'g'), '\\s+', ' ', 'g'))"
_RM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '\\b(?:inc|ltd|llc|ulc|corp|corporation|gmbh|limited|canada|pharmaceuticals|pharmaceutical|pharma|laboratories|laboratory|labs|biotechnology|biosciences|therapeutics|sciences|healthcare|health)\\b\\.?', '', 'g'), '[.,;'']', '', 'g'), '\\s+', ' ', 'g'))"
_ENTRIES = f"""p AS (SELECT DISTINCT {_RI.format(c="ingredient_name")} AS ingredient_key, {_RM.format(c="company_name")} AS company_key FROM activeingredient JOIN drugproduct USING (drug_code) WHERE {_RI.format(c="ingredient_name")} <> ''),
 m AS (SELECT noc_number, noc_manufacturer_name FROM api_main QUALIFY row_number() OVER (PARTITION BY noc_number ORDER BY row_id) = 1),
 r AS (SELECT row_id AS entry_no, {_RI.format(c="noc_pi_medic_ingr_name")} AS i, {_RM.format(c="noc_manufacturer_name")} AS f FROM api_medicinalingredient JOIN m USING (noc_number)),
 x AS (SELECT ingredient_key, company_key, count(*) AS n, min(entry_no) AS entry_no FROM p JOIN r ON company_key = f AND (contains(ingredient_key, i) OR contains(i, ingredient_key)) GROUP BY 1, 2)"""


def _register(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "activeingredient").select("drug_code", F.col("ingredient_name").alias("ingredient")).join(table(spark, d, "drugproduct").select("drug_code", F.col("company_name").alias("company")), "drug_code")
    main = relational.first_rows(table(spark, d, "api_main"), ["noc_number"], [F.col("row_id")]).select("noc_number", F.col("noc_manufacturer_name").alias("manufacturer"))
    entries = table(spark, d, "api_medicinalingredient").select(F.col("row_id").alias("entry_no"), "noc_number", F.col("noc_pi_medic_ingr_name").alias("medicinal_ingredient")).join(main, "noc_number")
    return register.register_entries(products, entries)


@query(f"WITH {_ENTRIES} SELECT ingredient_key, company_key, entry_no, 'exact' AS how FROM x WHERE n = 1")
def register_exact(spark: SparkSession, d: str) -> DataFrame:
    """Products with the one register entry of their ingredient and manufacturer."""
    return _register(spark, d).where("how = 'exact'")


@query()
def register_near(spark: SparkSession, d: str) -> DataFrame:
    """Products with the register entry of the likest manufacturer; no SQL has this likeness."""
    return _register(spark, d).where("how = 'near'")


@query(f"""WITH {_ENTRIES}, mart AS (SELECT l.row_id, l.active_ingredient AS ingredient, p.company_name AS company FROM store_labeling l JOIN (SELECT drug_code, company_name FROM drugproduct QUALIFY row_number() OVER (PARTITION BY drug_code ORDER BY row_id) = 1) p USING (drug_code))
 SELECT row_id, 'register_no_match' AS check_id, 'data_protection_ends' AS field, 'ERROR' AS severity, '2030-01-01' AS value FROM mart WHERE trim(ingredient) <> '' AND trim(company) <> ''
 AND NOT EXISTS (SELECT 1 FROM x WHERE n = 1 AND ingredient_key = {_RI.format(c="ingredient")} AND company_key = {_RM.format(c="company")})""")
def unregistered_protection(spark: SparkSession, d: str) -> DataFrame:
    """Labels said to be protected whose ingredient and company have no exact register entry."""
    one = relational.first_rows(table(spark, d, "drugproduct"), ["drug_code"], [F.col("row_id")]).select("drug_code", F.col("company_name").alias("company"))
    mart = table(spark, d, "store_labeling").select("row_id", "drug_code", F.col("active_ingredient").alias("ingredient"), F.lit("2030-01-01").cast("date").alias("data_protection_ends")).join(one, "drug_code")
    return grader.unregistered(mart, register_exact(spark, d), "row_id")


@query("SELECT row_id, check_id, field, severity, value, 0 AS run FROM (SELECT 0::BIGINT AS row_id, '' AS check_id, '' AS field, '' AS severity, '' AS value) WHERE false")
def rerun_differences(spark: SparkSession, d: str) -> DataFrame:
    """What two runs of the label grades differ in: nothing."""
    return grader.rerun_differences(lambda: label_grades(spark, d))


@query()
def label_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Every label field of each monograph with its page."""
    return label_fields.label_rows(table(spark, d, "piqray_pages"))


@query("""WITH w AS (SELECT DISTINCT din, drug_code FROM store_labeling WHERE din IS NOT NULL AND drug_code IS NOT NULL),
 c AS (SELECT drug_code, array_to_string(list_sort(list(DISTINCT upper(trim(ingredient_name)))), '; ') AS ai FROM activeingredient WHERE trim(ingredient_name) <> '' GROUP BY 1),
 u AS (SELECT drug_code, max(pdf_url) AS pdf_url FROM store_labeling WHERE drug_code IS NOT NULL GROUP BY 1),
 k AS (SELECT u.drug_code, u.pdf_url, c.ai, u.drug_code % 7 <> 0 AS ok FROM u LEFT JOIN c USING (drug_code)),
 f AS (SELECT pdf_url, active_ingredient, pack_size, color FROM store_labeling WHERE pdf_url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pdf_url ORDER BY fetched_at DESC, row_id DESC) = 1)
 SELECT w.din, w.drug_code, k.pdf_url, coalesce(nullif(trim(k.ai), ''), CASE WHEN k.pdf_url IS NULL THEN 'No PM available' ELSE f.active_ingredient END) AS active_ingredient, CASE WHEN k.pdf_url IS NULL THEN 'No PM available' ELSE f.pack_size END AS pack_size,
 CASE WHEN k.pdf_url IS NULL THEN 'No PM available' ELSE f.color END AS color FROM w JOIN k ON w.drug_code = k.drug_code AND k.ok LEFT JOIN f ON k.pdf_url = f.pdf_url WHERE k.pdf_url IS NULL OR f.pdf_url IS NOT NULL""")
def label_stages_merged(spark: SparkSession, d: str) -> DataFrame:
    """Labels of products by the catalogue's word and the document's: codes that failed for now (here by their number) write nothing."""
    t = table(spark, d, "store_labeling")
    ai = table(spark, d, "activeingredient").where("trim(ingredient_name) <> ''").groupBy("drug_code").agg(F.array_join(F.array_sort(F.collect_set(F.upper(F.trim("ingredient_name")))), "; ").alias("active_ingredient"))
    catalogue = t.where("drug_code IS NOT NULL").groupBy("drug_code").agg(F.max("pdf_url").alias("pdf_url")).join(ai, "drug_code", "left").withColumn("ok", F.col("drug_code") % 7 != 0)
    documents = relational.first_rows(t.where("pdf_url IS NOT NULL"), ["pdf_url"], [F.desc("fetched_at"), F.desc("row_id")]).select("pdf_url", F.lit(True).alias("ok"), "active_ingredient", "pack_size", "color")
    return label_fields.merged_labels(t.where("din IS NOT NULL AND drug_code IS NOT NULL").select("din", "drug_code").distinct(), catalogue, documents, ("active_ingredient",))




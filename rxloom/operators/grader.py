"""Checks of label, approval and patent fields of a mart, as expressions that findings() evaluates in one pass.

A check is (check_id, field, severity, fails). Checks of a stage that left no real value in the mart are not run. What
must agree with another table (ingredients, packaging text, page text, bulk patents, a register) is found by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxloom.functions.names import approval_din, real_value, register_ingredient, register_manufacturer
from rxloom.functions.similarity import containment_udf
from rxloom.operators.findings import findings, numbers

Check = tuple[str, str, str, Column]
#: Vocabularies and patterns of the fields.
CONTAINER_WORDS = (
    "prefilled syringe", "pre-filled syringe", "auto-injector", "auto injector", "autoinjector", "stick pack", "blister pack", "ampoule", "ampule", "ampul", "vial", "syringe", "cartridge", "blister",
    "bottle", "jar", "tube", "sachet", "pouch", "carton", "bag", "canister", "inhaler", "dropper", "suppository", "pen", "kit",
)
COLOR_WORDS = ("white", "red", "pink", "orange", "yellow", "green", "blue", "purple", "violet", "brown", "beige", "grey", "gray", "black", "cream", "tan", "teal", "maroon", "ivory")
SHAPE_WORDS = ("round", "oval", "ovaloid", "oblong", "capsule-shaped", "capsule shaped", "caplet", "biconvex", "pentagonal", "hexagonal", "octagonal", "triangular", "diamond", "shield", "kidney", "bean")
EXCIPIENT_POISON = r"(?i)debossed|administration\s+form|form\s*/\s*strength|administration\s+strength|tablets?\s+with\s+['\"]|strength\s+and\s+dosage|dosage\s+form"
HEADING_FRAGMENT = r":\s*$"
STYLE_HEADING = r"(?i)the following dosage strengths|dosage strengths|^\s*dosage\s+form"
SIZE = r"(?i)^\d+(?:\.\d+)?(?:\s*[×x]\s*\d+(?:\.\d+)?)?\s*mm$|^\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\s*mm$"
PH = r"^\d+(?:\.\d+)?(?:\s*[-–]\s*\d+(?:\.\d+)?)?$"
PH_SOLUBILITY, NO_APPROVAL, NO_DOCUMENT = "Not stated (pH-dependent solubility only)", "No NOC record", "No PM available"
LIQUID_FORMS = ("solution", "liquid", "injection", "infusion", "suspension", "syrup", "elixir", "oral drops")
SUBMISSION_TYPES = ("NDS", "ANDS", NO_APPROVAL, "New Drug Submission (NDS)", "Abbreviated New Drug Submission (ANDS)")
DOCUMENT_FIELDS = ("nonmedicinal_ingredients", "pack_size", "pack_style", "ph", "color", "shape", "size_mm", "weight")
APPROVAL_FIELDS = ("noc_date", "reason_for_supplement", "submission_class", "noc_submission_type")
STAGES = {"LABELING": ("active_ingredient", "nonmedicinal_ingredients", "ph", "color", "shape", "size_mm", "weight"), "PATENTS": ("patent_number",), "NOC": APPROVAL_FIELDS, "DP": ("data_protection_ends",)}


def any_of(conditions: list[Column]) -> Column:
    return F.exists(F.array(*conditions), lambda x: F.coalesce(x, F.lit(False))) if conditions else F.lit(False)


def has_word(c: Column, words: tuple[str, ...]) -> Column:
    """A whole word or phrase of the list occurs."""
    return c.rlike(r"\b(?:" + "|".join(w.replace("-", r"\-") for w in words) + r")\b")


def holds(c: Column, words: tuple[str, ...]) -> Column:
    return any_of([F.contains(c, F.lit(w)) for w in words])


def stages(mart: DataFrame) -> dict[str, bool]:
    """Which stages left a real value in the mart: one row reaches the driver."""
    here = {s: [c for c in cols if c in mart.columns] for s, cols in STAGES.items()}
    row = mart.agg(*[F.coalesce(F.bool_or(any_of([real_value(F.col(c)) for c in cols])), F.lit(False)).alias(s) for s, cols in here.items()]).first()
    return {s: bool(row[s]) for s in STAGES}


def excipient_checks(field: str) -> list[Check]:
    c, real = F.trim(F.col(field)), real_value(F.col(field))
    return [("excipient_poison", field, "ERROR", real & c.rlike(EXCIPIENT_POISON)), ("excipient_heading", field, "ERROR", real & c.rlike(HEADING_FRAGMENT))]


def pack_checks() -> list[Check]:
    style, size = F.trim("pack_style"), F.lower(F.trim("pack_size"))
    real = real_value(F.col("pack_style"))
    return [
        ("style_colon", "pack_style", "ERROR", real & style.rlike(HEADING_FRAGMENT)), ("style_heading", "pack_style", "ERROR", real & style.rlike(STYLE_HEADING)),
        ("style_vocabulary", "pack_style", "WARN", real & ~holds(F.lower(style), CONTAINER_WORDS)), ("size_container", "pack_size", "ERROR", real_value(F.col("pack_size")) & has_word(size, CONTAINER_WORDS)),
    ]


def descriptor_checks(preservatives: bool = False) -> list[Check]:
    """Size, pH, colour and shape; preservatives only of a mart that has the column."""
    size, ph, color = F.trim("size_mm"), F.trim("ph"), F.lower(F.trim("color"))
    sized, acid = real_value(F.col("size_mm")), real_value(F.col("ph")) & (ph != PH_SOLUBILITY)
    parts = F.filter(F.split(color, "[,/]+"), lambda p: F.trim(p) != "")
    out = [
        ("size_format", "size_mm", "ERROR", sized & ~size.rlike(SIZE)), ("size_range", "size_mm", "WARN", sized & size.rlike(SIZE) & F.exists(numbers(size), lambda x: (x < 2) | (x > 30))),
        ("ph_format", "ph", "ERROR", acid & ~ph.rlike(PH)), ("ph_range", "ph", "ERROR", acid & ph.rlike(PH) & F.exists(numbers(ph), lambda x: x > 14)),
        ("color_vocabulary", "color", "WARN", real_value(F.col("color")) & F.exists(parts, lambda p: ~has_word(p, COLOR_WORDS))),
        ("shape_vocabulary", "shape", "WARN", real_value(F.col("shape")) & ~holds(F.lower("shape"), SHAPE_WORDS)),
    ]
    if preservatives:
        out.append(("preservatives_value", "preservatives", "ERROR", real_value(F.col("preservatives")) & ~F.trim("preservatives").isin("Y", "N")))
    return out


def approval_checks() -> list[Check]:
    """Mixed sentinel, missing class, unknown submission type."""
    blank = lambda c: F.coalesce(F.trim(c) == NO_APPROVAL, F.lit(False))
    real = [real_value(F.col(c)) & ~blank(c) for c in APPROVAL_FIELDS]
    none = any_of([blank(c) for c in APPROVAL_FIELDS])
    kind = F.trim("noc_submission_type")
    every = real[0]
    for r in real[1:]:
        every = every & r
    return [
        ("approval_mixed", "noc_date", "ERROR", any_of(real) & none), ("class_missing", "noc_therapeutic_class", "INFO", every & ~real_value(F.col("noc_therapeutic_class"))),
        ("submission_type", "noc_submission_type", "ERROR", real_value(F.col("noc_submission_type")) & ~kind.isin(*SUBMISSION_TYPES)),
    ]


def patent_checks() -> list[Check]:
    """A declared count without a number; a number of more than eight characters."""
    number = F.regexp_replace(F.regexp_replace(F.trim("patent_number"), r"(?i)^\s*ca\s*", ""), r"[,\s]+", "")
    declared = F.col("patent_count").cast("string").try_cast("double")
    return [
        ("count_without_number", "patent_count", "WARN", (F.floor(declared) > 0) & ~real_value(F.col("patent_number"))),
        ("number_length", "patent_number", "WARN", real_value(F.col("patent_number")) & (F.length(number) > 8)),
    ]


def coherence_checks(as_of: Column) -> list[Check]:
    """Fields that contradict each other, of a mart with drug_code, dosage_form and data_protection_ends (a date)."""
    c = F.col
    none = lambda f: F.coalesce(F.trim(f) == NO_DOCUMENT, F.lit(False))
    real = {f: real_value(c(f)) & ~none(f) for f in DOCUMENT_FIELDS}
    return [
        ("ingredient_blank", "active_ingredient", "ERROR", real_value(c("drug_code")) & ~real_value(c("active_ingredient"))),
        ("mixed_sentinel", "pdf_url", "ERROR", any_of(list(real.values())) & any_of([none(f) for f in DOCUMENT_FIELDS])),
        ("no_appearance", "color", "WARN", real["nonmedicinal_ingredients"] & ~real["color"] & ~real["shape"]),
        ("weight_without_size", "size_mm", "WARN", real["weight"] & ~real["size_mm"]), ("size_without_weight", "weight", "WARN", real["size_mm"] & ~real["weight"]),
        ("liquid_without_ph", "ph", "WARN", holds(F.lower(F.coalesce("dosage_form", F.lit(""))), LIQUID_FORMS) & ~real_value(c("ph"))),
        ("protection_past", "data_protection_ends", "ERROR", c("data_protection_ends") < as_of),
    ]


def grade(mart: DataFrame, key: str, checks: dict[str, list[Check]]) -> DataFrame:
    """Findings of the checks of the stages that ran; checks under '' always run."""
    ran = stages(mart)
    return findings(mart, key, [x for s, some in checks.items() if ran.get(s, True) for x in some])


def column_findings(columns: list[str]) -> list[tuple[str, str, str]]:
    """(check_id, field, severity) of columns that a delivered mart must not have."""
    return [(f"column_{tail}", c, "ERROR") for c in columns for tail in ("url", "page") if c.endswith(f"_{tail}")]


def invented_values(mart: DataFrame, live: DataFrame, key: str, field: str, code: str, name: str, separators: str = "[;,]+") -> DataFrame:
    """(key, check_id, field, severity, value): parts of a field that no live record of the row's code has.

    live: code and name. Codes without live names aren't checked. Compared in upper case; repeated parts count once.
    """
    known = live.where(F.trim(name) != "").groupBy(code).agg(F.collect_set(F.upper(F.trim(name))).alias("_live"))
    parts = F.filter(F.transform(F.split(F.upper(F.col(field)), separators), lambda p: F.trim(p)), lambda p: p != "")
    extra = F.array_sort(F.array_except(parts, "_live"))
    rows = mart.where(real_value(F.col(field))).join(known, code).withColumn("_extra", extra).where(F.size("_extra") > 0)
    return rows.select(key, F.lit("invented").alias("check_id"), F.lit(field).alias("field"), F.lit("ERROR").alias("severity"), F.array_join("_extra", "; ").alias("value"))


def invented_pack(mart: DataFrame, info: DataFrame, key: str, code: str) -> DataFrame:
    """Numbers of a pack size, and containers of a pack style, that no packaging text (code, product_information) of the row's code has."""
    said = info.groupBy(code).agg(F.upper(F.concat_ws(" ", F.array_sort(F.collect_list("product_information")))).alias("_said"))
    rows = mart.join(said, code)
    found = F.regexp_extract_all(F.col("pack_size"), F.lit(r"(\d+(?:\.\d+)?)"), 1)
    absent = F.array_distinct(F.filter(found, lambda n: ~F.contains("_said", n) & ~F.contains("_said", F.substring_index(n, ".", 1))))
    style = real_value(F.col("pack_style")) & holds(F.lower("pack_style"), CONTAINER_WORDS) & ~holds(F.lower("_said"), CONTAINER_WORDS)
    size = rows.where(real_value(F.col("pack_size"))).withColumn("_n", F.explode(absent)).select(key, F.lit("size_invented").alias("check_id"), F.lit("pack_size").alias("field"), F.lit("ERROR").alias("severity"), F.col("_n").alias("value"))
    return size.unionByName(rows.where(style).select(key, F.lit("style_invented").alias("check_id"), F.lit("pack_style").alias("field"), F.lit("WARN").alias("severity"), F.col("pack_style").alias("value")))


def fabricated_excipients(mart: DataFrame, pages: DataFrame, key: str, field: str, code: str) -> DataFrame:
    """Parts of a list of at least three letters that are on no page of the row's code; of rows read by OCR nearly so will do.

    mart: key, code, field, needs_ocr; pages: code, text. Only distinct (code, part) meet the pages of their code; what a
    page holds word for word never reaches Python. A part only nearly found is an INFO. Codes without pages aren't checked.
    """
    parts = F.array_distinct(F.filter(F.transform(F.split(F.col(field), r"[,;]\s*"), lambda p: F.trim(p)), lambda p: F.length(p) >= 3))
    rows = mart.where(real_value(F.col(field))).select(key, code, (F.col("needs_ocr") == 1).alias("_ocr"), F.explode(parts).alias("value"))
    texts = pages.where(F.col("text").isNotNull()).select(code, F.col("text"))
    asked = rows.groupBy(code, "value").agg(F.bool_or(F.coalesce("_ocr", F.lit(False))).alias("_any"))
    exact = F.contains(F.lower("text"), F.lower("value"))
    seen = asked.join(texts, code).withColumn("_exact", exact)
    sure = seen.groupBy(code, "value").agg(F.bool_or("_exact").alias("_exact"))
    near = seen.join(sure.where("NOT _exact").select(code, "value"), [code, "value"], "left_semi").where("_any").groupBy(code, "value").agg(F.max(containment_udf("value", "text")).alias("_near"))
    told = rows.join(sure, [code, "value"]).where("NOT _exact").join(near, [code, "value"], "left")
    fuzzy = F.coalesce(F.col("_ocr") & (F.col("_near") > 0), F.lit(False))
    return told.select(key, F.when(fuzzy, "excipient_nearly").otherwise("excipient_fabricated").alias("check_id"), F.lit(field).alias("field"), F.when(fuzzy, "INFO").otherwise("ERROR").alias("severity"), "value")


def ghost_patents(mart: DataFrame, bulk: DataFrame, key: str) -> DataFrame:
    """Patent numbers of the mart that the bulk file lacks or has without a filing date; both with a patent_number."""
    clean = F.regexp_replace(F.regexp_replace(F.trim("patent_number"), r"(?i)^\s*ca\s*", ""), r"[,\s]+", "")
    known = bulk.where(F.trim("filing_date") != "").select(clean.alias("_n")).where("_n <> ''").distinct()
    rows = mart.where(real_value(F.col("patent_number"))).withColumn("_n", clean).where("_n <> ''")
    return rows.join(known, "_n", "left_anti").select(key, F.lit("ghost_patent").alias("check_id"), F.lit("patent_number").alias("field"), F.lit("ERROR").alias("severity"), F.col("patent_number").alias("value"))


def unregistered(mart: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """Rows with a protection date whose (ingredient, company) the register join gave no entry."""
    rows = mart.where(real_value(F.col("data_protection_ends").cast("string")) & (F.trim("ingredient") != "") & (F.trim("company") != ""))
    rows = rows.withColumn("_i", register_ingredient(F.col("ingredient"))).withColumn("_c", register_manufacturer(F.col("company")))
    return rows.join(matched.select(F.col("ingredient_key").alias("_i"), F.col("company_key").alias("_c")).distinct(), ["_i", "_c"], "left_anti").select(
        key, F.lit("register_no_match").alias("check_id"), F.lit("data_protection_ends").alias("field"), F.lit("ERROR").alias("severity"), F.col("data_protection_ends").cast("string").alias("value")
    )


def rerun_differences(make) -> DataFrame:
    """Rows that one of two runs of the same plan has more often than the other: none, if it is determinate."""
    a, b = make(), make()
    return a.exceptAll(b).withColumn("run", F.lit(1)).unionByName(b.exceptAll(a).withColumn("run", F.lit(2)))


def report(found: DataFrame, limit: int = 60) -> str:
    """A Markdown summary: findings by severity and check, and the first of them; the whole is written as CSV by the caller."""
    by = found.groupBy("severity", "check_id").agg(F.count("*").alias("n")).orderBy("severity", "check_id").collect()
    first = found.orderBy(*found.columns).limit(limit).collect()
    table = lambda head, rows: ["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *("| " + " | ".join(str(v if v is not None else "").replace("|", "\\|")[:120] for v in r) + " |" for r in rows)]
    return "\n".join(["# Findings", "", *table(["severity", "check", "count"], by), "", *table(found.columns, first), ""])


__all__ = ["approval_din", "grade", "stages"]

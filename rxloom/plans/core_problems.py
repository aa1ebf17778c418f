"""Queries of the general training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxloom.functions.text import amount, any_date, no_blanks, normalize_din, squeeze
from rxloom.operators.multivalue import split_values
from rxloom.operators.sketch_diff import compare_copies
from rxloom.operators.snapshots import deliveries, latest_rows, snapshot_changes, with_values
from rxloom.operators.units import convert_quantities, parse_quantities
from rxloom.sources.tables import table

COMPARED = ["product_key", "dollars", "units"]


def sales_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_rows(
        table(spark, d, "old_extract"), "snapshot_no", "line_key", "loaded_at", "row_id",
        product_key=F.upper(no_blanks(F.coalesce("product", F.lit("")))), dollars=amount(F.col("dollars_mat_2024_06")), units=amount(F.col("units_mat_2024_06")),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    snapshots, rows = deliveries(table(spark, d, "old_extract"), "snapshot_no")
    return snapshot_changes(sales_latest(spark, d), COMPARED, snapshots, rows).select("snapshot_no", F.col("key").alias("line_key"), "change_kind")


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    """The differing lines with their values before and after."""
    snapshots, rows = deliveries(table(spark, d, "old_extract"), "snapshot_no")
    latest = sales_latest(spark, d)
    return with_values(snapshot_changes(latest, COMPARED, snapshots, rows), latest, COMPARED, snapshots).withColumnRenamed("key", "line_key")


def strength_observations(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "old_extract").select("row_id", F.col("line_key").alias("history"), F.col("snapshot_no").alias("at"), "strength", F.lit(None).alias("unit"))
    ingredients = table(spark, d, "activeingredient").select("row_id", F.xxhash64("drug_code", "active_ingredient_code").alias("history"), F.col("row_id").alias("at"), "strength", F.col("strength_unit").alias("unit"))
    approvals = table(spark, d, "api_medicinalingredient").select(
        "row_id", F.xxhash64("noc_pi_din_product_id", F.upper(squeeze(F.col("noc_pi_medic_ingr_name")))).alias("history"), F.col("row_id").alias("at"),
        F.col("noc_pi_strength").cast("decimal(30,9)").cast("string").alias("strength"), F.col("noc_pi_unit").alias("unit"),
    )
    return parse_quantities([("old_extract", lines), ("activeingredient", ingredients), ("api_medicinalingredient", approvals)])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return convert_quantities(strength_observations(spark, d)).where("written AND amount IS NOT NULL").select("source_table", "row_id", "position_no", "quantity_kind", "amount")


def p3_converted(spark: SparkSession, d: str) -> DataFrame:
    """Every number, those without a unit too, with what its history implies."""
    return convert_quantities(strength_observations(spark, d))


DATE_FIELDS = ["filing_date", "grant_date", "expiry_date"]


def patent_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Both copies, one row per key: din and patent number packed in one long, dates typed.

    Keys without eight digits of din after padding, or without seven of the patent number, name no pair.
    """

    def side(t: DataFrame, order: str, tie: str, dates: dict[str, str]) -> DataFrame:
        din, pn = normalize_din(F.col("din")), F.regexp_replace("patent_number", r"\D", "")
        rows = t.select(
            (din.cast("long") * 10_000_000 + pn.cast("long")).alias("key"),
            F.struct(F.col(order).alias("o"), F.col(tie).alias("t"), *[F.col(c).alias(n) for n, c in dates.items()]).alias("m"),
            ((F.length(din) == 8) & (F.length(pn) == 7)).alias("named"),
        ).where("named")
        last = rows.groupBy("key").agg(F.max("m").alias("m"))
        return last.select("key", *[any_date(F.col(f"m.{n}")).alias(n) for n in dates])

    store = side(table(spark, d, "store_patents"), "fetched_at", "row_id", {f: f for f in DATE_FIELDS})
    bulk = side(table(spark, d, "patent_bulk"), "line_no", "line_no", dict(zip(DATE_FIELDS, ["filing_date", "date_granted", "expiration_date"])))
    return store, bulk


def p4_differences(spark: SparkSession, d: str) -> DataFrame:
    store, bulk = patent_sides(spark, d)
    found = compare_copies(store, bulk, DATE_FIELDS, names=("store", "bulk"))
    return found.select(
        F.lpad(F.floor(F.col("key") / 10_000_000).cast("string"), 8, "0").alias("din"),
        F.lpad((F.col("key") % 10_000_000).cast("string"), 7, "0").alias("patent_number"),
        "difference", F.col("left_value").alias("store_value"), F.col("right_value").alias("bulk_value"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_differences(spark, d).select("din", "patent_number", "difference")


def p4_unusable_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows of either copy that name no pair: what the comparison can't hold against the other copy."""
    one = lambda t, key: table(spark, d, t).select(F.lit(t).alias("source_table"), F.col(key).alias("row_no"), "din", "patent_number")
    rows = one("store_patents", "row_id").unionByName(one("patent_bulk", "line_no"))
    named = (F.length(normalize_din(F.col("din"))) == 8) & (F.length(F.regexp_replace("patent_number", r"\D", "")) == 7)
    return rows.where(~F.coalesce(named, F.lit(False)))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return split_values(
        [
            ("activeingredient", table(spark, d, "activeingredient"), "row_id", "ingredient_name", "substances"),
            ("old_extract", table(spark, d, "old_extract"), "row_id", "combined_molecule", "substances"),
            ("store_labeling", table(spark, d, "store_labeling"), "row_id", "nonmedicinal_ingredients", "listed"),
        ]
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_values(spark, d).drop("flag")


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p3_found, p3_converted, p4_found, p4_differences, p4_unusable_keys, p6_found, p6_values)}

#: The same results in plain SQL, where it can express them.
_AMOUNT = r"""CASE WHEN {c} IS NULL OR regexp_replace({c}, '[\s\x{{00A0}}\x{{2009}}\x{{202F}}$,]', '', 'g') IN ('', '-') THEN 0.0
 ELSE TRY_CAST(regexp_replace(regexp_replace({c}, '[\s\x{{00A0}}\x{{2009}}\x{{202F}}$,]', '', 'g'), '^\((.*)\)$', '-\1') AS DOUBLE) END"""
_LATEST = rf"""latest AS (SELECT snapshot_no, line_key,
   upper(regexp_replace(coalesce(product, ''), '[\s\x{{00A0}}\x{{2009}}\x{{202F}}]', '', 'g')) AS p, {_AMOUNT.format(c="dollars_mat_2024_06")} AS d, {_AMOUNT.format(c="units_mat_2024_06")} AS u
 FROM old_extract WHERE snapshot_no IS NOT NULL AND line_key IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY snapshot_no, line_key ORDER BY loaded_at DESC NULLS LAST, row_id DESC) = 1),
 pairs AS (SELECT snapshot_no AS b, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS a FROM (SELECT DISTINCT snapshot_no FROM old_extract WHERE snapshot_no IS NOT NULL))"""
_DATE = """CASE WHEN {c} IS NULL THEN NULL ELSE coalesce(
 CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d+-\\d+$') THEN try_strptime(trim({c}), '%Y-%m-%d') END,
 CASE WHEN regexp_matches(trim({c}), '^\\d{{4}} \\d+ \\d+$') THEN try_strptime(trim({c}), '%Y %m %d') END,
 CASE WHEN regexp_matches(trim({c}), '^\\d{{8}}$') THEN try_strptime(trim({c}), '%Y%m%d') END,
 CASE WHEN regexp_matches(trim({c}), '^\\d+/\\d+/\\d{{4}}$') THEN try_strptime(trim({c}), '%m/%d/%Y') END,
 try_strptime(trim({c}), '%d %b %Y'), try_strptime(trim({c}), '%B %d, %Y'), try_strptime(trim({c}), '%d %B %Y'), try_strptime(trim({c}), '%b %d, %Y'))::DATE END"""
_SIDE = """{name} AS (SELECT lpad(regexp_replace(din, '\\D', '', 'g'), 8, '0') AS din, regexp_replace(patent_number, '\\D', '', 'g') AS patent_number,
  {f} AS f, {g} AS g, {e} AS e FROM {table}
  WHERE length(regexp_replace(din, '\\D', '', 'g')) BETWEEN 1 AND 8 AND length(regexp_replace(patent_number, '\\D', '', 'g')) = 7
  QUALIFY row_number() OVER (PARTITION BY lpad(regexp_replace(din, '\\D', '', 'g'), 8, '0'), regexp_replace(patent_number, '\\D', '', 'g') ORDER BY {order}) = 1)"""

_UNNAMED = "NOT coalesce(length(regexp_replace(din, '\\D', '', 'g')) BETWEEN 1 AND 8 AND length(regexp_replace(patent_number, '\\D', '', 'g')) = 7, false)"

SQL = {
    "p4_unusable_keys": f"SELECT 'store_patents' AS source_table, row_id AS row_no, din, patent_number FROM store_patents WHERE {_UNNAMED} UNION ALL SELECT 'patent_bulk', line_no, din, patent_number FROM patent_bulk WHERE {_UNNAMED}",
    "p2_found": f"""WITH {_LATEST}
 SELECT b AS snapshot_no, line_key, change_kind FROM (
  SELECT p.b, coalesce(n.line_key, o.line_key) AS line_key, CASE WHEN o.line_key IS NULL THEN 'added' WHEN n.line_key IS NULL THEN 'removed'
    WHEN n.p IS DISTINCT FROM o.p OR n.d IS DISTINCT FROM o.d OR n.u IS DISTINCT FROM o.u THEN 'changed' END AS change_kind
  FROM (SELECT pairs.b, latest.* FROM pairs JOIN latest ON latest.snapshot_no = pairs.b WHERE pairs.a IS NOT NULL) n
  FULL JOIN (SELECT pairs.b, latest.* FROM pairs JOIN latest ON latest.snapshot_no = pairs.a) o ON n.b = o.b AND n.line_key = o.line_key
  JOIN pairs p ON p.b = coalesce(n.b, o.b)) WHERE change_kind IS NOT NULL""",
    "p4_found": f"""WITH {_SIDE.format(name="s", table="store_patents", f=_DATE.format(c="filing_date"), g=_DATE.format(c="grant_date"), e=_DATE.format(c="expiry_date"), order="fetched_at DESC NULLS LAST, row_id DESC")},
 {_SIDE.format(name="b", table="patent_bulk", f=_DATE.format(c="filing_date"), g=_DATE.format(c="date_granted"), e=_DATE.format(c="expiration_date"), order="line_no DESC NULLS LAST")},
 j AS (SELECT din, patent_number, s.din IS NULL AS no_s, b.din IS NULL AS no_b, s.f AS sf, b.f AS bf, s.g AS sg, b.g AS bg, s.e AS se, b.e AS be FROM s FULL JOIN b USING (din, patent_number))
 SELECT din, patent_number, 'missing_in_store' AS difference FROM j WHERE no_s
 UNION ALL SELECT din, patent_number, 'missing_in_bulk' FROM j WHERE no_b
 UNION ALL SELECT din, patent_number, 'filing_date' FROM j WHERE NOT no_s AND NOT no_b AND sf IS DISTINCT FROM bf
 UNION ALL SELECT din, patent_number, 'grant_date' FROM j WHERE NOT no_s AND NOT no_b AND sg IS DISTINCT FROM bg
 UNION ALL SELECT din, patent_number, 'expiry_date' FROM j WHERE NOT no_s AND NOT no_b AND se IS DISTINCT FROM be""",
}

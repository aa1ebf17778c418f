"""Null in any column, and columns that aren't expected, change nothing but the rows they are in."""

import pytest

from pyspark.sql import functions as F
from rxloom.plans import core_problems
from rxloom.sources.tables import table

TABLES = {
    "p2_found": {"old_extract": ["line_key", "snapshot_no", "loaded_at", "row_id", "product", "dollars_mat_2024_06", "units_mat_2024_06"]},
    "p2_changes": {"old_extract": ["line_key", "snapshot_no", "loaded_at", "row_id", "product", "dollars_mat_2024_06", "units_mat_2024_06"]},
    "p3_found": {"old_extract": ["row_id", "line_key", "snapshot_no", "strength"], "activeingredient": ["row_id", "drug_code", "active_ingredient_code", "strength", "strength_unit"], "api_medicinalingredient": ["row_id", "noc_pi_din_product_id", "noc_pi_medic_ingr_name", "noc_pi_strength", "noc_pi_unit"]},
    "p4_found": {"store_patents": ["row_id", "din", "patent_number", "filing_date", "grant_date", "expiry_date", "fetched_at"], "patent_bulk": ["line_no", "din", "patent_number", "filing_date", "date_granted", "expiration_date"]},
    "p6_found": {"activeingredient": ["row_id", "ingredient_name"], "old_extract": ["row_id", "combined_molecule"], "store_labeling": ["row_id", "nonmedicinal_ingredients"]},
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_nulls_and_extra_columns(spark, sf, monkeypatch, name):
    def holed(spark_, d, t):
        df = table(spark_, d, t)
        for i, c in enumerate(TABLES[name].get(t, [])):
            df = df.withColumn(c, F.when(F.pmod(F.xxhash64(F.struct(*df.columns), F.lit(i)), F.lit(9)) != 0, F.col(c)))
        for extra in ("key", "digest", "bucket", "h", "salt", "at", "history", "text", "m", "_m", "named", "grammar"):
            if extra not in df.columns and TABLES[name].get(t):
                df = df.withColumn(extra, F.lit("x"))
        return df

    monkeypatch.setattr(core_problems, "table", holed)
    assert core_problems.QUERIES[name](spark, sf).collect()
    monkeypatch.setattr(core_problems, "table", lambda s, d, t: table(s, d, t).where(F.lit(False)))
    assert core_problems.QUERIES[name](spark, sf).count() == 0

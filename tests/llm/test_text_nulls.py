"""Null in any column, and columns that aren't expected, change nothing but the rows they are in."""

import pytest

from pyspark.sql import functions as F
from rxloom.llm import queries
from rxloom.sources.tables import table

TABLES = {
    "p1_found": {"piqray_pages": ["page_id", "monograph_id", "page", "text"]}, "p5_found": {"company_names": ["name_id", "spelling"]}, "p10_found": {"documents": ["doc_id", "text"]},
    "p7_found": {"old_extract": ["line_key", "snapshot_no", "loaded_at", "row_id", "product", "manufacturer", "strength", "combined_molecule"], "drugproduct": ["drug_code", "brand_name", "company_name", "company_code", "last_update_date"], "activeingredient": ["drug_code", "ingredient_name", "strength", "strength_unit"], "company_names": ["name_id", "spelling"]},
    "p8_packing": {"documents": ["doc_id", "text", "lang", "source"]}, "p9_choice": {"documents": ["doc_id", "text", "lang", "source"], "mix_targets": ["mix_name", "source", "target_share", "max_repeats"]},
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_nulls_and_extra_columns(spark, sf, monkeypatch, name):
    def holed(spark_, d, t):
        df = table(spark_, d, t)
        for i, c in enumerate(TABLES[name].get(t, [])):
            df = df.withColumn(c, F.when(F.pmod(F.xxhash64(F.struct(*df.columns), F.lit(i)), F.lit(9)) != 0, F.col(c)))
        for extra in ("key", "firm", "n_tokens", "block", "n", "tokens", "digest", "registered", "full"):
            if extra not in df.columns and TABLES[name].get(t):
                df = df.withColumn(extra, F.lit("x"))
        return df

    monkeypatch.setattr(queries, "table", holed)
    rows = queries.QUERIES[name](spark, sf).collect()
    assert rows
    monkeypatch.setattr(queries, "table", lambda s, d, t: table(s, d, t).where(F.lit(False)) if TABLES[name].get(t) else table(s, d, t))
    assert queries.QUERIES[name](spark, sf).count() == 0

"""A product's entry in a register: its ingredient holds the register's or the other way round, and the manufacturer agrees.

Ingredients meet by an equi-join on first characters (relational.containment_pairs) over distinct normalised names, so
neither side is multiplied by the other. A single exact manufacturer decides; several are ambiguous and give none; without
one, the likest manufacturer of the shortlist counts from a likeness of 0.8.
"""

from __future__ import annotations

from difflib import get_close_matches

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rxloom.functions.names import register_ingredient, register_manufacturer
from rxloom.operators.relational import containment_pairs

#: Fixed value: the least likeness of manufacturers that aren't the same.
LEAST = 0.8


@F.pandas_udf(StringType())
def closest(name: pd.Series, options: pd.Series) -> pd.Series:
    return pd.Series([next(iter(get_close_matches(n, list(o), n=1, cutoff=LEAST)), None) if n else None for n, o in zip(name, options)])


def register_entries(products: DataFrame, register: DataFrame) -> DataFrame:
    """(ingredient_key, company_key, entry_no, how): the entry of each distinct normalised (ingredient, company) that has one.

    products: ingredient, company; register: entry_no (unique, in the register's order), medicinal_ingredient,
    manufacturer. how is `exact` or `near`; of entries of the same nearest manufacturer the first counts. A product
    without ingredient has none, and neither has an entry whose ingredient is empty once normalised.
    """
    p = products.select(register_ingredient(F.col("ingredient")).alias("ingredient_key"), register_manufacturer(F.col("company")).alias("company_key")).where("ingredient_key <> ''").distinct()
    r = register.select("entry_no", register_ingredient(F.col("medicinal_ingredient")).alias("i"), register_manufacturer(F.col("manufacturer")).alias("m"))
    held = containment_pairs(p.select(F.col("ingredient_key").alias("a")).distinct(), r.where("i <> ''").select(F.col("i").alias("b")).distinct())
    listed = r.groupBy("i", "m").agg(F.count("*").alias("n"), F.min("entry_no").alias("entry_no"))
    fits = held.join(listed, F.col("b") == F.col("i")).select(F.col("a").alias("ingredient_key"), "m", "n", "entry_no")
    short = fits.groupBy("ingredient_key", "m").agg(F.sum("n").alias("n"), F.min("entry_no").alias("entry_no"))
    exact = p.join(short, "ingredient_key").where("m = company_key")
    one = exact.where("n = 1").select("ingredient_key", "company_key", "entry_no", F.lit("exact").alias("how"))
    open_ = p.where("company_key <> ''").join(exact.select("ingredient_key", "company_key"), ["ingredient_key", "company_key"], "left_anti")
    options = short.groupBy("ingredient_key").agg(F.array_sort(F.collect_set("m")).alias("options"))
    near = open_.join(options, "ingredient_key").withColumn("m", closest("company_key", "options")).where("m IS NOT NULL").drop("options")
    return one.unionByName(near.join(short.select("ingredient_key", "m", "entry_no"), ["ingredient_key", "m"]).select("ingredient_key", "company_key", "entry_no", F.lit("near").alias("how")))

"""Sales groups matched one to one to catalogue products: a reservation of exact brands, then a fuzzy pass.

A group and a product can only meet with the same strengths, as many molecules, and each molecule of the group sharing a
word with the product's. Both sides are co-grouped on strengths and number of molecules, and an index of words gives each
group its candidates; within a co-group the global order of the groups matters: what an earlier one takes a later one
can't have. A co-group holds distinct groups and products of one strength, not sales rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.functions.names import brand_identity
from rxloom.functions.similarity import company_core, ratio, strength_key_udf

#: Thresholds of the scores, which are halves of brand and company similarity in percent.
CONFIDENT, LEAST, LEAST_COMPANY, MARGIN, ALIAS_COMPANY = 65.0, 55.0, 55.0, 15.0, 85.0
NEVER_SOLD = {"approved", "cancelled pre market"}
RESULT = "group_id long, status string, din string, top_score double, second_score double"


def component_words(c: Column, separators: str) -> Column:
    """Words of at least four letters of each component; a component may have none."""
    parts = F.filter(F.split(F.upper(F.coalesce(c, F.lit(""))), separators), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.array_distinct(F.regexp_extract_all(p, F.lit("([A-Z]{4,})"), 1)))


#: What separates the molecules of a sales group, and the ingredients of a product.
SOLD_SEPARATORS, PRODUCT_SEPARATORS = "[:/;+,|&!]| WITH ", ";"


class Candidates:
    """Products of one strength and number of molecules, found by the words of a group's molecules."""

    def __init__(self, words: list[list[list[str]]]):
        self.every = frozenset(range(len(words)))
        self.by_word: dict[str, set[int]] = {}
        for i, parts in enumerate(words):
            for w in {w for p in parts for w in p}:
                self.by_word.setdefault(w, set()).add(i)

    def of(self, parts: list[list[str]]) -> list[int]:
        left = self.every
        for p in parts:
            if len(p):
                left = left & set().union(*(self.by_word.get(w, ()) for w in p))
        return sorted(left)


def generic_brand(brand: str, molecule: str, fillers: frozenset[str] = frozenset()) -> bool:
    """The brand says nothing but the molecule, or the fillers."""
    words = set(re.findall("[a-z]+", brand.lower()))
    return bool(words) and words <= set(re.findall("[a-z]+", (molecule or "").lower())) | fillers


def match_groups(groups: list[dict], products: list[dict]) -> list[tuple]:
    """Results of groups in order. groups: id, brand, company, molecule, and base (places of its candidates, all by default);
    products: din, brand, company, status."""
    everyone = range(len(products))
    score = {}

    def company(g: dict, p: dict) -> float:
        k = ("c", g["company"], p["company"])
        if k not in score:
            score[k] = ratio(g["company"], p["company"])
        return score[k]

    def both(g: dict, p: dict) -> float:
        k = ("b", g["brand"], p["brand"])
        if k not in score:
            score[k] = ratio(g["brand"], p["brand"])
        return 0.5 * score[k] + 0.5 * company(g, p)

    def on_market(free: list[dict]) -> list[dict]:
        return [p for p in free if p["status"] == "marketed"] or free

    reserved: dict[int, str] = {}
    taken: set[str] = set()
    for g in groups:
        free = on_market([p for i in g.get("base", everyone) if (p := products[i])["din"] not in taken])
        exact = [p for p in free if p["brand"] == g["brand"] and g["brand"] and company(g, p) >= LEAST_COMPANY]
        if len(exact) != 1:
            continue
        mine = 50 + 0.5 * company(g, exact[0])
        if any(p is not exact[0] and company(g, p) >= LEAST_COMPANY and mine - both(g, p) < MARGIN for p in free):
            continue
        reserved[g["id"]] = exact[0]["din"]
        taken.add(exact[0]["din"])
    by_din = {p["din"]: p for p in products}
    first_pass, out = dict(reserved), []
    for g in groups:
        if g["id"] in reserved:
            out.append((g["id"], "matched", reserved[g["id"]], both(g, by_din[reserved[g["id"]]]), 0.0))
            continue
        free = on_market([p for i in g.get("base", everyone) if (p := products[i])["din"] not in taken])
        scored = sorted(((both(g, p), -i, p["din"]) for i, p in enumerate(free) if company(g, p) >= LEAST_COMPANY), reverse=True)
        kept = [x for x in scored if x[0] >= LEAST]
        top, second = (scored[0][0] if scored else 0.0), (scored[1][0] if len(scored) > 1 else 0.0)
        if not kept:
            base = {products[i]["din"] for i in g.get("base", everyone)}
            fit = sorted(((company(g, by_din[d]), d) for d in base & set(first_pass.values()) if company(g, by_din[d]) >= ALIAS_COMPANY), reverse=True)
            if generic_brand(g["brand"], g["molecule"]) and fit and (len(fit) == 1 or fit[0][0] > fit[1][0]):
                out.append((g["id"], "matched", fit[0][1], top, second))
            else:
                out.append((g["id"], "no_match", "", top, second))
        elif len(kept) > 1 and kept[0][0] - kept[1][0] < MARGIN:
            out.append((g["id"], "ambiguous", "", top, second))
        elif kept[0][0] < CONFIDENT:
            out.append((g["id"], "low_score", kept[0][2], top, second))
        else:
            taken.add(kept[0][2])
            out.append((g["id"], "matched", kept[0][2], top, second))
    return out


def with_keys(d: DataFrame, strength: str, molecule: str, separators: str) -> DataFrame:
    """Adds skey (strengths), words (of each molecule) and parts (number of molecules)."""
    return d.withColumn("skey", strength_key_udf(strength)).withColumn("words", component_words(F.col(molecule), separators)).withColumn("parts", F.size("words"))


def match_sales(sold: DataFrame, products: DataFrame) -> DataFrame:
    """One row per sales group with its status and product, and one per product that no group has.

    sold: combined_molecule, product, manufacturer, strength, unique together; products: din, ingredient, brand_name,
    company, strength, status. Groups without strength or molecule match nothing; null fields count as empty; of rows
    with the same din the first by brand counts. Empty tables give the other side's rows without a match.
    """
    keys = ["combined_molecule", "product", "manufacturer", "strength"]
    g = sold.select(*keys).withColumn("group_id", F.xxhash64(*[F.coalesce(F.col(k), F.lit("")) for k in keys]))
    g = with_keys(g, "strength", "combined_molecule", SOLD_SEPARATORS).withColumn("brand", brand_identity(F.col("product")))
    p = products.where("din IS NOT NULL").withColumn("status", F.lower(F.trim(F.coalesce("status", F.lit("")))))
    p = p.where(~F.col("status").isin(*NEVER_SOLD)).withColumn("n", F.row_number().over(Window.partitionBy("din").orderBy("brand_name"))).where("n = 1")
    p = with_keys(p, "strength", "ingredient", PRODUCT_SEPARATORS).withColumn("brand", brand_identity(F.col("brand_name")))
    usable = (F.col("skey") != "") & (F.size("words") > 0)

    def one(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple]:
        find = Candidates([list(w) for w in right["words"]])
        groups = [{"id": r.group_id, "brand": r.brand, "company": company_core(r.manufacturer), "molecule": r.combined_molecule, "base": find.of(r.words)} for r in left.itertuples()]
        options = [{"din": r.din, "brand": r.brand, "company": company_core(r.company), "status": r.status} for r in right.itertuples()]
        return match_groups(groups, options)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.fillna("").sort_values(keys), right.fillna("").sort_values("din")
        by, out, none = dict(iter(right.groupby(["skey", "parts"], sort=False))), [], right.iloc[:0]
        for k, part in left.groupby(["skey", "parts"], sort=False):
            out += one(part, by.get(k, none))
        return pd.DataFrame(out, columns=["group_id", "status", "din", "top_score", "second_score"]).round({"top_score": 1, "second_score": 1})

    # many small groups share a task; the number of tasks follows the session's partitions
    bucket = F.pmod(F.xxhash64("skey", "parts"), F.lit(8 * int(sold.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("bucket")
    left = g.where(usable).select(bucket, "skey", "parts", "words", "group_id", "brand", *keys)
    right = p.where(usable).select(bucket, "skey", "parts", "words", "din", "brand", "company", "status")
    matched = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(run, RESULT)
    groups = g.select("group_id", *keys).join(matched, "group_id", "left").na.fill({"status": "no_match", "din": "", "top_score": 0.0, "second_score": 0.0})
    unsold = p.select("din").join(groups.where("status = 'matched'").select("din").distinct(), "din", "left_anti").select("din", F.lit("not_sold").alias("status"))
    return groups.drop("group_id").unionByName(unsold, allowMissingColumns=True)


def confidence(status: Column, score: Column) -> Column:
    return F.when((status == "matched") & (score >= 99.95), "exact").when((status == "matched") & (score >= 85), "high").when(status.isin("matched", "low_score"), "low").otherwise("none")

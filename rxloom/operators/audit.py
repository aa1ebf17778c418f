"""Audit of matches between sales groups and products, made without trusting the matcher that produced them.

For every pair the brand is weighed anew, and rivals with the same strengths are looked for on either side:
a product of the group's company whose brand fits the group better, a group of the product's company whose brand fits
the product better. Groups and products are co-grouped like in the matcher, so that all rivals of a pair are at hand.
Only the best rival counts, and only if it is good enough: it is looked for by bounds of the brand's likeness, and
companies are compared where the brand could do.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxloom.functions.names import brand_identity
from rxloom.functions.similarity import GENERIC_FILLERS, Alike, common, company_core, ratio, reaches, strength_key_udf, truncated_brand
from rxloom.operators.matcher import LEAST_COMPANY, MARGIN, PRODUCT_SEPARATORS, SOLD_SEPARATORS, generic_brand, with_keys

#: A brand below the floor was matched on the company; a rival must be this good itself.
BRAND_FLOOR, RIVAL_LEAST, EXACT = 72.0, 60.0, 100.0
AUDIT = "din string, product string, manufacturer string, brand_sim double, company_sim double, flags string, rival string, suspicion double, tier string"


def better(own: float, rivals: list[tuple[float, str]]) -> tuple[float, str] | None:
    """The best rival, if it is good and far enough better, or exact where the own one isn't."""
    top = max(rivals, default=None)
    if top and top[0] > own and ((top[0] >= RIVAL_LEAST and top[0] - own >= MARGIN) or top[0] >= EXACT > own):
        return top
    return None


@lru_cache(200_000)
def akin(product: str, group: str) -> bool:
    return reaches(product, group, LEAST_COMPANY)


class Rivals:
    """One side of a co-group by brand and by company."""

    def __init__(self, rows: list[dict], name: str):
        self.name, self.by = name, {}
        for r in sorted(rows, key=lambda r: r[name], reverse=True):
            self.by.setdefault(r["brand"], []).append(r)
        self.brands, self.sizes = Alike([b for b in self.by if b]), Counter(r["company"] for r in rows if r["company"])
        self.companies = Alike(list(self.sizes))

    def best(self, own: float, brand: str, like: Callable[[str, str], float], fits: Callable[[dict], bool]) -> list[tuple[float, str]]:
        """Likeness and name of the likest row that fits, the last by name, if better() may take it. like: of a brand here and the given one."""
        if own >= EXACT or not brand:
            return []
        top: tuple[float, str] | None = None
        floor = min(EXACT, max(RIVAL_LEAST, own + MARGIN)) - 1e-9
        for bound, b in self.brands.to(brand, floor):
            if bound < floor:
                break
            if 2.0 * common(b, brand) / (len(b) + len(brand)) * 100 < floor or (r := next((x for x in self.by[b] if fits(x)), None)) is None:
                continue
            if (x := like(b, brand)) >= floor and (top is None or (x, r[self.name]) > top):
                top, floor = (x, r[self.name]), x
        return [top] if top else []

    def alone(self, company: str) -> bool:
        """Just one row has a company akin to this one."""
        n = 0
        for _, c in self.companies.to(company, LEAST_COMPANY):
            n += self.sizes[c] if akin(c, company) else 0
            if n > 1:
                return False
        return n == 1


def audit_pair(g: dict, p: dict, groups: Rivals | list[dict], products: Rivals | list[dict]) -> tuple:
    groups, products = (x if isinstance(x, Rivals) else Rivals(x, n) for x, n in ((groups, "product"), (products, "din")))
    brand, company = ratio(p["brand"], g["brand"]), ratio(p["company"], g["company"])
    flags, rival, score = [], [], 0.0
    if brand < BRAND_FLOOR:
        flags.append("company_carried")
        score += BRAND_FLOOR - brand
    if b := better(brand, products.best(brand, g["brand"], ratio, lambda o: o["din"] != p["din"] and akin(o["company"], g["company"]))):
        flags.append("better_product")
        rival.append(b[1])
        score += b[0] - brand
    if b := better(brand, groups.best(brand, p["brand"], lambda x, y: ratio(y, x), lambda o: o is not g and akin(p["company"], o["company"]))):
        flags.append("better_group")
        rival.append(b[1])
        score += b[0] - brand
    # a weak brand alone is no evidence where the company has no other product and the label is general or cut short
    forced = flags == ["company_carried"] and (generic_brand(g["brand"], g["molecule"], GENERIC_FILLERS) or truncated_brand(g["brand"], p["brand"])) and products.alone(g["company"])
    return p["din"], g["product"], g["manufacturer"], round(brand, 1), round(company, 1), ",".join(flags), ",".join(rival), round(score, 1), "low" if forced else "high" if flags else "none"


def audit_matches(matched: DataFrame, sold: DataFrame, products: DataFrame) -> DataFrame:
    """One row per matched pair with similarities, flags, rivals, suspicion and tier.

    matched: combined_molecule, product, manufacturer, strength, din of matched groups; sold and products as for the
    matcher. Pairs whose strengths differ have no common rivals and are left out. Groups without a product are rivals only;
    products without a number are none; of rows with the same din the first by brand is the pair's. Empty tables give no rows.
    """
    keys = ["combined_molecule", "product", "manufacturer", "strength"]
    g = with_keys(sold.select(*keys).distinct(), "strength", "combined_molecule", SOLD_SEPARATORS).withColumn("brand", brand_identity(F.col("product")))
    pairs = matched.where("din <> ''").select(*[F.col(k).alias(f"m_{k}") for k in keys], "din")
    g = g.join(pairs, [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys], "left").drop(*[f"m_{k}" for k in keys])
    p = with_keys(products.where("trim(din) <> ''"), "strength", "ingredient", PRODUCT_SEPARATORS).withColumn("brand", brand_identity(F.col("brand_name")))
    tasks = int(sold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("skey"), F.lit(8 * tasks)).alias("bucket")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        by = dict(iter(right.fillna("").sort_values("brand_name", ascending=False).groupby("skey", sort=False)))
        for k, part in left.fillna("").groupby("skey", sort=False):
            if k not in by or not (part["din"] != "").any():
                continue
            groups = [{"product": r.product, "manufacturer": r.manufacturer, "brand": r.brand, "company": company_core(r.manufacturer), "molecule": r.combined_molecule, "din": r.din} for r in part.itertuples()]
            options = [{"din": r.din, "brand": r.brand, "company": company_core(r.company)} for r in by[k].itertuples()]
            of, sides = {o["din"]: o for o in options}, (Rivals(groups, "product"), Rivals(options, "din"))
            out += [audit_pair(x, of[x["din"]], *sides) for x in groups if x["din"] in of]
        return pd.DataFrame(out, columns=[f.split()[0] for f in AUDIT.split(", ")])

    # few bytes, much work: partitions of a given number are not coalesced by their size
    left, right = (d.repartition(tasks, "bucket") for d in (g.select(bucket, "skey", "din", "brand", *keys), p.select(bucket, "skey", "din", "brand", "brand_name", "company")))
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInPandas(run, AUDIT)


def decompose(total: tuple[int, ...], parts: list[tuple[int, ...]], most: int = 3) -> tuple[int, ...] | None:
    """Places of the fewest parts, two at least, that add up to the total in every metric; sums of two are looked up."""
    for k in range(2, most + 1):
        last = {p: i for i, p in enumerate(parts)}
        for c in combinations(range(len(parts)), k - 1):
            rest = tuple(t - sum(parts[i][m] for i in c) for m, t in enumerate(total))
            if (i := last.get(rest)) is not None and i > c[-1]:
                return (*c, i)
    return None


VALUES = "din string, product string, manufacturer string, kind string, groups int"


def audit_values(stamped: DataFrame, sold: DataFrame, metrics: list[str]) -> DataFrame:
    """Which sales group, or sum of groups, the metrics of each product are: kind is `group`, `sum` or `orphan`.

    stamped: din, brand_name, company, strength and the metrics; sold: combined_molecule, product, manufacturer, strength,
    unique together, and the metrics, as whole numbers. A group has all of the product's values; of several the one with
    the likest brand is meant. Else the fewest groups of the product's strengths and company, two or three, that add up to
    them, named by the likest brand. Products without metrics are left out. Empty tables give no rows.
    """
    keys = ["combined_molecule", "product", "manufacturer", "strength"]
    whole = [F.coalesce(F.col(m), F.lit(0)).cast("long").alias(m) for m in metrics]
    g = sold.select(*keys, *whole).withColumn("skey", strength_key_udf("strength")).withColumn("brand", brand_identity(F.col("product"))).fillna("", keys)
    p = stamped.where(F.coalesce(*metrics).isNotNull()).select("din", "company", *whole, strength_key_udf("strength").alias("skey"), brand_identity(F.col("brand_name")).alias("brand")).fillna("", ["company"])
    bucket = F.pmod(F.xxhash64("skey"), F.lit(8 * int(sold.sparkSession.conf.get("spark.sql.shuffle.partitions")))).alias("bucket")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, by = [], dict(iter(left.groupby("skey", sort=False)))
        for k, part in right.groupby("skey", sort=False):
            groups = sorted(by[k].to_dict("records"), key=lambda r: [r[c] for c in keys]) if k in by else []
            values = [tuple(r[m] for m in metrics) for r in groups]
            for r in part.to_dict("records"):
                own = tuple(r[m] for m in metrics)
                found, kind = [x for x, v in zip(groups, values) if v == own], "group"
                if not found:
                    akin = [i for i, x in enumerate(groups) if ratio(company_core(r["company"]), company_core(x["manufacturer"])) >= LEAST_COMPANY]
                    places = decompose(own, [values[i] for i in akin])
                    found, kind = [groups[akin[i]] for i in places or ()], "sum" if places else "orphan"
                best = max(found, key=lambda x: ratio(r["brand"], x["brand"]), default={"product": None, "manufacturer": None})
                out.append((r["din"], best["product"], best["manufacturer"], kind, 1 if kind == "group" else len(found)))
        return pd.DataFrame(out, columns=["din", "product", "manufacturer", "kind", "groups"])

    return g.select(bucket, "*").groupBy("bucket").cogroup(p.select(bucket, "*").groupBy("bucket")).applyInPandas(run, VALUES)

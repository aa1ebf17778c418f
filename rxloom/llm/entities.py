"""Sales lines and catalogue drugs matched without a common identifier, each match with a confidence.

Lines and drugs are reduced to profiles (brand, firm, strengths, molecules, form) and distinct ones compared, so that a
line sold through many channels counts once. Candidate pairs share two or three attributes exactly; no block is a cross of
all that share a single frequent value. A pair's similarity vector is explained by a mixture of two Gaussians, matched and
unmatched, fitted without labels by expectation-maximisation over the candidates and as many pairs drawn by hash, which
show what candidates can't: pairs without anything in common. There is one similarity an attribute, so the covariances
are diagonal, and floored, since the similarities are nearly discrete; a missing similarity says nothing.

Transitivity: a profile has at most one drug, so in each expectation step the odds of its candidates compete with each
other and with having none; and two profiles of one drug are the same product, so a pair's posterior is no more than that
of the profile and the drug's surest profile being one. The posterior alone decides.

Similarities are on a grid, so profiles whose candidates have the same vectors are one weighted row for the fit, however
many there are; a few dozen sums reach the driver in each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rxloom.functions.arrow import Memo, arrow_schema
from rxloom.functions.peg import SUBSTANCES, parse
from rxloom.functions.quantity import quantities, rounded
from rxloom.functions.text import squeeze
from rxloom.llm.names import link_names
from rxloom.session import cut

#: Words of dosage forms in brand fields.
FORMS = "TABLETS?|TABS?|COMPRIMES?|CAPSULES?|CAPS?|GELULES?|INJECTIONS?|INJ|SOLUTIONS?|SOL|SUSPENSIONS?|SUS|CREAMS?|CREME|CRM|GELS?|OINTMENTS?|ONGUENT|ONT|POWDERS?|POUDRE|PWS|ER|XR|SR|ORAL|TOPICAL"
_UNITS = "MILLIGRAMS?|MICROGRAMS?|GRAMS?|MCG|MGS?|UG|ΜG|µG|GM?|%(?: W/W)?|PERCENT|PCT|(?:THOUSAND |MILLION )?(?:IU|I\\.U\\.|INTERNATIONAL UNITS|UNITS?|U)"
STRENGTH = rf"(?:[\s/+;-]*\d[\d,.]*\s*(?:{_UNITS})?\.?(?:(?:/|\s*PER\s*|\.)\s*\d*\s*(?:ML|G|L|MG)\b(?:-1)?)?)+"
FEATURES = ("brand_sim", "firm_sim", "strength_sim", "molecule_sim", "form_sim")
#: Fits end when no parameter moves more than this, or after so many rounds; variances have a floor.
MOVED, ROUNDS, FLOOR = 0.002, 50, 0.0025
#: Log odds are kept within this.
BOUND = 40.0
#: Profiles of a block that one salt holds.
BLOCK_ROWS = 5_000
FIELDS = ["brand", "whole", "firm", "firm_key", "strengths", "molecules", "form"]


def brand_tokens(c: Column) -> Column:
    """Words of a brand in upper case, without strength, dosage form, trade marks and signs."""
    up = F.upper(F.regexp_replace(squeeze(c), "[®™©]", ""))
    bare = F.regexp_replace(up, rf"(?<![A-Z0-9]){STRENGTH}(?![A-Z])", " ")
    forms = F.regexp_replace(bare, rf"(?<![A-Z-])(?:{FORMS})(?![A-Z])", " ")
    words = F.filter(F.split(forms, "[^A-Z0-9]+"), lambda w: w != "")
    return F.when(F.size(words) > 0, words).otherwise(F.filter(F.split(up, "[^A-Z0-9]+"), lambda w: w != ""))


def without_firm(words: Column, firm_words: Column) -> Column:
    """Words that are neither a word of the firm's name nor a short form of one, if enough is left of the brand."""
    rest = F.filter(words, lambda w: ~F.exists(firm_words, lambda f: (f == w) | ((F.length(w) >= 3) & f.startswith(w))))
    return F.when(firm_words.isNotNull() & (F.length(F.array_join(rest, "")) >= 4), rest).otherwise(words)


def firm_words(names: DataFrame, firms: DataFrame) -> DataFrame:
    """(firm, words): words of at least four letters that a fifth of a firm's spellings, and at least two, share.

    At most as many words as five spellings hold, however many the firm has.
    """
    one = names.join(firms, "name_id").select("firm", F.explode(F.array_distinct(F.filter(F.split(F.upper("spelling"), "[^A-Z]+"), lambda w: F.length(w) >= 4))).alias("w"))
    size = firms.groupBy("firm").agg(F.count("*").alias("n"))
    words = one.groupBy("firm", "w").agg(F.count("*").alias("k")).join(size, "firm").where("k * 5 >= n AND (k >= 2 OR n <= 3)")
    return words.groupBy("firm").agg(F.collect_list("w").alias("words"))


def parsed_sets(df: DataFrame, strength: str, unit: str | None, molecule: str, mark: bool = False) -> DataFrame:
    """Adds strengths (sorted `kind:amount`) and molecules (sorted base names) as canonical strings; '' if unknown.

    mark: a row without a usable strength is `?` and its molecules.
    """
    schema = StructType([*df.schema.fields, StructField("strengths", StringType()), StructField("molecules", StringType())])
    target = arrow_schema_of(df, ", strengths string, molecules string")

    def strengths(key: tuple[str | None, str | None]) -> str:
        found = {f"{u[0]}:{rounded(n * u[1])}" for n, u in quantities(*key) if u and u[0] != "unknown"}
        return "|".join(sorted(found))

    def unusable(found: str, named: str) -> str:
        return found or (f"?{named}" if mark else "")

    def molecules(text: str | None) -> str:
        values = parse(text, SUBSTANCES)
        base = {v.upper().split("(")[0].split()[0] for _, v, _ in values if v.split("(")[0].split()}
        return "|".join(sorted(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, m = Memo(strengths, 50_000), Memo(molecules, 50_000)
        for b in batches:
            units = b.column(unit).to_pylist() if unit else [None] * b.num_rows
            a = [s[k] for k in zip(b.column(strength).to_pylist(), units)]
            c = [m[k] for k in b.column(molecule).to_pylist()]
            a = [unusable(x, y) for x, y in zip(a, c)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(a, pa.string()), pa.array(c, pa.string())], schema=target)

    return df.mapInArrow(run, schema)


def arrow_schema_of(df: DataFrame, more: str) -> pa.Schema:
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return arrow_schema(df.sparkSession, names + more)


def line_profiles(sales: DataFrame) -> DataFrame:
    """(line_key, product, manufacturer, strength, molecule): of each line the fullest and then the latest row."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False)).cast("int")
    full = has("product") + has("manufacturer") + has("combined_molecule") + F.coalesce(F.col("strength").rlike(r"\d"), F.lit(False)).cast("int") * 2
    row = F.struct(full.alias("full"), F.col("snapshot_no").alias("s"), F.col("loaded_at").alias("l"), F.col("row_id").alias("r"), *[F.col(c) for c in ("product", "manufacturer", "strength", "combined_molecule")])
    best = sales.where("line_key IS NOT NULL").groupBy("line_key").agg(F.max(row).alias("m"))
    return best.select("line_key", "m.product", "m.manufacturer", "m.strength", F.col("m.combined_molecule").alias("molecule"))


def drug_profiles(catalogue: DataFrame, ingredients: DataFrame) -> DataFrame:
    """(drug_code, product, company, strengths, molecules): latest record of each drug that has a brand and a company."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False)).cast("int")
    row = F.struct((has("brand_name") + has("company_name")).alias("full"), F.col("last_update_date").alias("u"), F.col("row_id").alias("r"), F.col("brand_name").alias("product"), F.col("company_name").alias("company"))
    catalogue = catalogue.select("row_id", "drug_code", "brand_name", "company_name", "company_code", "last_update_date")
    by_code = catalogue.where(has("company_name") == 1).groupBy("company_code").agg(F.min("company_name").alias("registered"))
    filled = catalogue.where("drug_code IS NOT NULL").join(by_code, "company_code", "left").withColumn("company_name", F.when(has("company_name") == 1, F.col("company_name")).otherwise(F.col("registered")))
    last = filled.groupBy("drug_code").agg(F.max(row).alias("m")).select("drug_code", "m.product", "m.company")
    rows = ingredients.where("drug_code IS NOT NULL").select("drug_code", "ingredient_name", "strength", "strength_unit")
    sets = parsed_sets(rows, "strength", "strength_unit", "ingredient_name", mark=True)
    told = parsed_sets(last.select("drug_code", "product", F.lit(None).cast("string").alias("none")), "product", None, "none").select("drug_code", F.col("strengths").alias("told"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(F.filter(F.flatten(F.collect_set(F.split(c, r"\|"))), lambda x: x != ""))), "|")
    return last.join(sets.groupBy("drug_code").agg(join("strengths").alias("strengths"), join("molecules").alias("molecules")), "drug_code", "left").na.fill("", ["strengths", "molecules"]).join(told, "drug_code").withColumn("strengths", F.when((F.col("told") != "") & (F.col("strengths").contains("?") | (F.col("strengths") == "")), F.col("told")).otherwise(F.col("strengths"))).drop("told")


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a, b) of profiles that share two or three attributes."""
    firm, brand, strength, molecule = (F.coalesce(F.col(c), F.lit("")) for c in ("firm", "brand", "strengths", "molecules"))
    blocks = [
        ((firm != "") & (strength != "") & (molecule != ""), F.xxhash64(F.lit(1), firm, strength, molecule)),
        ((brand != "") & (strength != ""), F.xxhash64(F.lit(2), brand, strength)),
        ((brand != "") & (firm != ""), F.xxhash64(F.lit(3), brand, firm)),
        ((firm != "") & (strength != "") & (F.length(brand) >= 3), F.xxhash64(F.lit(4), firm, strength, F.substring(brand, 1, 3))),
        ((molecule != "") & (strength != "") & (F.length(brand) >= 3), F.xxhash64(F.lit(5), molecule, strength, F.substring(brand, 1, 3))),
        ((molecule != "") & (firm != "") & (F.length(brand) >= 4), F.xxhash64(F.lit(6), molecule, firm, F.substring(brand, 1, 4))),
    ]

    def keyed(d: DataFrame, i: str) -> DataFrame:
        keys = F.array_compact(F.array(*[F.when(ok, k) for ok, k in blocks]))
        return d.select(F.col("id").alias(i), F.explode(keys).alias("block"))

    left, right = keyed(a, "a"), keyed(b, "b")
    # a block that many profiles share is spread over salts; its drugs go to each of them
    hot = left.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("salts")).where("salts > 1")
    left = left.join(hot, "block", "left").select("a", "block", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    right = right.join(hot, "block", "left").select("b", "block", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return left.join(right, ["block", "salt"]).select("a", "b").distinct()


def background(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b) drawn by hash, about one for each a: what unmatched pairs look like that no block brings together."""
    at = lambda d, i, seed: d.select(F.col("id").alias(i), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, size))).alias("k"))
    return at(a, "a", 5).join(at(b, "b", 6), "k").select("a", "b")


def similarities(p: str, q: str) -> list[Column]:
    """Similarity vector of two profiles whose fields have the prefixes p and q, on a grid; null where a side says nothing."""
    x, y = (lambda c: F.col(f"{p}{c}")), (lambda c: F.col(f"{q}{c}"))
    text = lambda u, v: 1 - F.levenshtein(u, v) / F.greatest(F.length(u), F.length(v), F.lit(1))

    def brands(u: Column, v: Column) -> Column:
        cut_off = ((F.length(u) >= 5) & v.startswith(u)) | ((F.length(v) >= 5) & u.startswith(v))
        return F.when(u == v, 1.0).when(cut_off, F.greatest(F.lit(0.9), text(u, v))).otherwise(text(u, v))

    def sets(u: Column, v: Column) -> Column:
        m, n = F.split(u, r"\|"), F.split(v, r"\|")
        return F.when((u == "") | (v == ""), F.lit(None)).when(u == v, 1.0).otherwise(F.size(F.array_intersect(m, n)) / F.size(F.array_union(m, n)))

    def amounts(u: Column, v: Column) -> Column:
        """Of a line and a drug; a drug's unusable strengths may be any: null if the others fit and their number does."""
        m, n = F.split(u, r"\|"), F.filter(F.split(v, r"\|"), lambda z: ~z.startswith("?"))
        open_ = F.size(F.split(v, r"\|")) - F.size(n)
        fits = (F.size(F.array_except(n, m)) == 0) & (F.size(m) == F.size(n) + open_)
        return F.when(F.contains(v, F.lit("?")), F.when((u != "") & ~fits, 0.0)).otherwise(sets(u, v))

    same_firm = (x("firm") == y("firm")) & x("firm").isNotNull()
    firm = F.when(same_firm, 1.0).when((x("firm_key") != "") & (y("firm_key") != ""), F.lit(0.8) * text(x("firm_key"), y("firm_key")))
    brand = F.greatest(brands(x("brand"), y("brand")), brands(x("whole"), y("whole")))
    form = F.when((x("form") != "") & (y("form") != ""), (x("form") == y("form")).cast("double"))
    values = (brand, firm, amounts(x("strengths"), y("strengths")), sets(x("molecules"), y("molecules")), form)
    return [F.round(v, 2).alias(f) for v, f in zip(values, FEATURES)]


def similarity(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with their similarity vectors. a, b: id and the profile's fields."""
    side = lambda d, p: d.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in FIELDS])
    return pairs.join(side(a, "a"), "a").join(side(b, "b"), "b").select(*pairs.columns, *similarities("a_", "b_"))


class Mixture:
    """Two Gaussians with diagonal, floored covariances: prior of a match, means and variances of (unmatched, matched)."""

    def __init__(self, weight: float, means: np.ndarray, variances: np.ndarray):
        self.weight, self.means, self.variances = weight, means, variances

    def parameters(self) -> np.ndarray:
        return np.concatenate(([self.weight], self.means.ravel(), np.sqrt(self.variances).ravel()))

    def terms(self) -> np.ndarray:
        """(square, linear, constant) of the log odds of each feature."""
        (m0, m1), (v0, v1) = self.means, self.variances
        return np.stack([0.5 / v0 - 0.5 / v1, m1 / v1 - m0 / v0, 0.5 * (m0 * m0 / v0 - m1 * m1 / v1 + np.log(v0 / v1))])

    def prior(self) -> float:
        return float(np.log(self.weight / (1 - self.weight)))

    def odds_of(self, x: np.ndarray) -> np.ndarray:
        """Odds of a match by the similarities that are there."""
        square, linear, constant = self.terms()
        return np.exp(np.clip(self.prior() + np.nansum((square * x + linear) * x + constant, 1), -BOUND, BOUND))

    def odds(self) -> Column:
        """The same as a column."""
        gap = F.lit(self.prior())
        for f, (square, linear, constant) in zip(FEATURES, self.terms().T.tolist()):
            gap = gap + F.coalesce((F.lit(square) * F.col(f) + F.lit(linear)) * F.col(f) + F.lit(constant), F.lit(0.0))
        return F.exp(F.least(F.greatest(gap, F.lit(-BOUND)), F.lit(BOUND)))


def signatures(pairs: DataFrame) -> DataFrame:
    """(vectors, n): the similarity vectors of a profile's candidates with their counts, and how many profiles have the same."""
    vectors = pairs.groupBy("a", *FEATURES).agg(F.count("*").alias("k"))
    of_one = vectors.groupBy("a").agg(F.array_sort(F.collect_list(F.struct(*FEATURES, "k"))).alias("vectors"))
    return of_one.groupBy("vectors").agg(F.count("*").alias("n"))


def fit(pairs: DataFrame, rounds: int = ROUNDS) -> Mixture | None:
    """Expectation-maximisation over all pairs (a, similarities); None if there are none.

    It starts from the pairs that agree in most respects and ends when the parameters stay. Each partition of signatures gives
    its sums of (posterior, posterior of pairs with the similarity, first and second moments), unmatched and matched.
    """
    seen, d = cut(signatures(pairs)), len(FEATURES)

    def expectation(model: Mixture | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total_sums = np.zeros(2 * (1 + 3 * d))
            for b in batches:
                lists = b.column("vectors")
                length = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                x = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES], 1)
                k, n = flat.field("k").to_numpy(), np.repeat(b.column("n").to_numpy(), length)
                if not len(k):
                    continue
                if model is None:
                    odds = np.where((x[:, :4] > 0.75).all(1), 19.0, 1 / 19)
                else:
                    odds = model.odds_of(x)
                starts = np.cumsum(length) - length
                total = 1 + np.add.reduceat(odds * k, starts)
                p = odds / np.repeat(total, length)
                there, z = ~np.isnan(x), np.nan_to_num(x)
                total_sums += np.concatenate([y for w in (n * k * (1 - p), n * k * p) for y in ([w.sum()], w @ there, w @ z, w @ (z * z))])
            yield pa.RecordBatch.from_pydict({"sums": [total_sums.tolist()]})

        return run

    model = None
    for _ in range(rounds):
        row = np.zeros((2, 1 + 3 * d))
        for r in seen.mapInArrow(expectation(model), "sums array<double>").collect():  # one row a partition
            row += np.array(r.sums).reshape(2, -1)
        mass, there = row[:, 0], np.maximum(row[:, 1 : d + 1], 1e-9)
        if mass.min() < 1e-6:
            return model
        means = row[:, d + 1 : 2 * d + 1] / there
        new = Mixture(float(np.clip(mass[1] / mass.sum(), 1e-4, 1 - 1e-4)), means, np.maximum(row[:, 2 * d + 1 :] / there - means * means, 0.0) + FLOOR)
        if model is not None and np.abs(new.parameters() - model.parameters()).max() < MOVED:
            return new
        model = new
    return model


def best_drugs(pairs: DataFrame, model: Mixture) -> DataFrame:
    """(a, b, posterior, similarities) of the likeliest candidate of each profile; its candidates' odds compete."""
    scored = pairs.withColumn("odds", model.odds())
    best = F.max_by(F.struct("b", "odds", *FEATURES), F.struct("odds", -F.col("b"))).alias("m")
    return scored.groupBy("a").agg(F.sum("odds").alias("all"), best).select("a", "m.b", (F.col("m.odds") / (1 + F.col("all"))).alias("posterior"), *[f"m.{f}" for f in FEATURES]).where("posterior >= 0.5")


def consistent(best: DataFrame, profiles: DataFrame, model: Mixture) -> DataFrame:
    """The pairs whose profile may be one with the surest profile of the same drug, with posteriors bounded by that."""
    mine = profiles.select(F.col("id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in FIELDS])
    rows = best.join(mine, "a")
    top = rows.groupBy("b").agg(F.max_by(F.struct(F.col("a").alias("top"), F.col("posterior").alias("top_p"), *[F.col(f"a_{c}").alias(f"t_{c}") for c in FIELDS]), F.struct(F.round("posterior", 6), "brand_sim", -F.col("a"))).alias("t"))
    both = rows.join(top, "b").select("a", "b", "posterior", *FEATURES, *[f"a_{c}" for c in FIELDS], "t.*")
    alike = both.select("a", "b", "posterior", "top", "top_p", F.struct(*FEATURES).alias("own"), *similarities("a_", "t_"))
    odds = model.odds()
    bound = F.when(F.col("a") == F.col("top"), 1.0).otherwise(odds / (1 + odds) / F.col("top_p"))
    return alike.select("a", "b", F.least("posterior", bound).alias("posterior"), "own.*").where("posterior >= 0.5")


def match(sales: DataFrame, catalogue: DataFrame, ingredients: DataFrame, names: DataFrame, name_rows: int) -> DataFrame:
    """(line_key, drug_code, posterior, brand_sim, firm_sim, strength_sim, molecule_sim, form_sim): the drug of each line.

    A match is the likeliest drug of its line with a posterior of at least 1/2. Drugs of equal profiles are one drug, which
    has the smallest of their codes. Lines or drugs without brand match nothing. Empty tables give no rows.
    """
    firms = link_names(names, name_rows)
    firms = cut(firms)
    ids = names.select(F.col("name_id").cast("long"), "spelling").where("name_id IS NOT NULL AND trim(spelling) <> ''")
    named = ids.join(firms, "name_id").groupBy("spelling").agg(F.min("firm").alias("firm")).join(firm_words(ids, firms), "firm", "left")
    named = cut(named.withColumn("firm", F.col("firm").cast("string")))
    key = F.regexp_replace(F.upper("company"), "[^A-Z0-9]", "")

    def profile(d: DataFrame, ids: list[str]) -> DataFrame:
        form = F.upper(F.regexp_extract("product", rf"(?i)(?<![A-Z-])({FORMS})(?![A-Z])", 1))
        with_firm = d.join(named.withColumnRenamed("spelling", "company"), "company", "left").withColumn("tokens", brand_tokens(F.col("product")))
        brand = F.array_join(without_firm(F.col("tokens"), F.col("words")), "").alias("brand")
        return with_firm.select(*ids, brand, F.array_join("tokens", "").alias("whole"), "firm", F.coalesce(key, F.lit("")).alias("firm_key"), "strengths", "molecules", F.coalesce(F.substring(form, 1, 3), F.lit("")).alias("form")).where("brand <> ''")

    # read twice: for the distinct profiles and for the lines that have them
    lines = cut(line_profiles(sales).withColumn("text", F.when(F.col("strength").rlike(r"\d"), F.col("strength")).otherwise(F.col("product"))).drop("strength"))
    raw = ["product", "manufacturer", "text", "molecule"]
    distinct = parsed_sets(lines.select(*raw).distinct(), "text", None, "molecule").withColumnRenamed("manufacturer", "company")
    one_id = F.xxhash64(*[x for f in FIELDS for x in (F.col(f), F.col(f).isNull())])
    typed = cut(profile(distinct, [F.xxhash64("product", F.col("company"), "text", "molecule").alias("raw_id")]).withColumn("id", one_id))
    a = cut(typed.select("id", *FIELDS).dropDuplicates(["id"]))
    b = cut(profile(drug_profiles(catalogue, ingredients), ["drug_code"]).groupBy(*FIELDS).agg(F.min("drug_code").cast("long").alias("id")))
    drawn = candidates(a, b).withColumn("drawn", F.lit(False)).unionByName(background(a, b, b.count()).withColumn("drawn", F.lit(True)))
    everything = cut(similarity(a, b, drawn))
    model = fit(everything)
    pairs = everything.where("NOT drawn")
    if model is None:
        return pairs.select(F.col("a").alias("line_key"), F.col("b").alias("drug_code"), F.lit(0.0).alias("posterior"), *FEATURES).limit(0)
    best = consistent(cut(best_drugs(pairs, model)), a, model)
    rows = lines.select("line_key", F.xxhash64("product", "manufacturer", "text", "molecule").alias("raw_id")).join(typed.select("raw_id", F.col("id").alias("a")), "raw_id")
    return rows.join(best, "a").select("line_key", F.col("b").alias("drug_code"), "posterior", *FEATURES)

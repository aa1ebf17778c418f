"""Orders, stamps and summaries of the delivered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxloom.session import cut

#: Rank of a reconciliation outcome of a product.
OUTCOMES = {"matched": 3, "low_score": 2, "not_sold": 1}


def numbered(df: DataFrame, order: list[Column], name: str = "position", first: int = 1) -> DataFrame:
    """The rows with their place in the order, without sorting them in one task: ranges are sorted and counted, and each
    range starts after the rows of those before. The driver gets one count a range; the order must be total to be determinate."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1]) for r in laid.groupBy("_part").agg(F.count("*")).collect())
    before, total = {}, first
    for part, n in counts:
        before[part] = total
        total += n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(first)
    # within a range the ids that Spark gives go up by one from the range's first
    return laid.withColumn(name, (F.col("_at").bitwiseAND((1 << 33) - 1) + offset).cast("long")).drop("_part", "_at")


def striped(df: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rows of a group numbered, and every second one marked."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("row_no", n).withColumn("shaded", n % 2 == 0)


def signal_order(df: DataFrame, group: list[str], dollars: str) -> DataFrame:
    """Largest groups first, the rows of a group together and by falling amount."""
    total = F.sum(dollars).over(Window.partitionBy(*group))
    return df.withColumn("group_total", total).orderBy(F.desc("group_total"), *group, F.desc(dollars))


def move_order(df: DataFrame, old: str, new: str, keys: list[str]) -> DataFrame:
    return df.orderBy(F.desc(F.abs(F.col(new) - F.col(old))), *keys)


def group_order(df: DataFrame, query: str, label: str, count: str) -> DataFrame:
    """Groups that are exactly what was asked for first, then the larger, then by label."""
    return df.orderBy((F.upper(F.trim(label)) != query.strip().upper()).cast("int"), F.desc(count), label)


def suspicious_order(audit: DataFrame) -> DataFrame:
    """The high tier before the low one, each by falling suspicion; what isn't suspicious is left out."""
    # the shuffle keeps the rows of the audit: the order reads its input twice
    return audit.where("suspicion > 0").repartition("din").orderBy((F.col("tier") != "high").cast("int"), F.desc("suspicion"), "din")


def stamped(sheet: DataFrame, found: DataFrame, key: str, order: list[Column], metrics: list[str]) -> DataFrame:
    """The sheet with each key's sums of the metrics on its first row only, so that a total counts them once."""
    sums = found.groupBy(key).agg(*[F.sum(m).alias(m) for m in metrics])
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    rows = sheet.drop(*metrics).withColumn("_first", first).join(sums, key, "left")
    return rows.select(*[c for c in sheet.columns if c not in metrics], *[F.when(F.col("_first"), F.col(m)).alias(m) for m in metrics])


def best_outcomes(recon: DataFrame, order: list[Column]) -> DataFrame:
    """(din, status, top_score, confidence) of the best outcome of each product, the first of equals."""
    from rxloom.operators.matcher import confidence

    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])[F.col("status")], F.lit(0))
    n = F.row_number().over(Window.partitionBy("din").orderBy(F.desc(rank), *order))
    best = recon.where(F.trim("din") != "").withColumn("_n", n).where("_n = 1")
    return best.select("din", "status", "top_score", confidence(F.col("status"), F.coalesce("top_score", F.lit(0.0))).alias("confidence"))


def with_confidence(sheet: DataFrame, recon: DataFrame, order: list[Column]) -> DataFrame:
    """The sheet with the confidence of each product's match; `none` without an outcome."""
    best = best_outcomes(recon, order).select("din", F.col("confidence").alias("match_confidence"))
    return sheet.join(best, "din", "left").fillna("none", ["match_confidence"])


def filings_of(products: DataFrame, filings: DataFrame, tokens: Column, ingredient: Column) -> DataFrame:
    """Products with the number of filings whose set of molecule words is the same; sets are equal as sorted arrays."""
    counted = filings.select(ingredient.alias("_t")).where(F.size("_t") > 0).groupBy("_t").agg(F.count("*").alias("filings"))
    return products.withColumn("_t", tokens).join(counted, "_t", "left").drop("_t").fillna(0, ["filings"])


def patched(sheet: DataFrame, labels: DataFrame, chosen: DataFrame, fields: list[str]) -> DataFrame:
    """The sheet with the label fields of the chosen products from the store; a product without a label there keeps its own."""
    new = labels.join(chosen.select("din").distinct(), "din", "left_semi").select("din", F.lit(True).alias("_has"), *[F.col(f).alias(f"_{f}") for f in fields])
    return sheet.join(new, "din", "left").select(*[F.when(F.coalesce("_has", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in sheet.columns])


def completeness(extract: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """(expected, missed, missed_rate) of the extract's keys that weren't delivered."""
    e = extract.select(key).where(F.col(key).isNotNull()).distinct()
    missed = e.join(delivered.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return missed.agg(F.count("*").alias("expected"), F.count_if(F.col("_in").isNull()).alias("missed")).withColumn("missed_rate", F.when(F.col("expected") > 0, F.round(F.col("missed") / F.col("expected"), 6)).otherwise(F.lit(0.0)))


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """(true_positive, false_positive, false_negative, true_negative, precision, recall) of two yes-or-no columns."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    out = df.agg(F.count_if(p & a).alias("true_positive"), F.count_if(p & ~a).alias("false_positive"), F.count_if(~p & a).alias("false_negative"), F.count_if(~p & ~a).alias("true_negative"))
    part = lambda n, m: F.when(F.col(n) + F.col(m) > 0, F.round(F.col(n) / (F.col(n) + F.col(m)), 6))
    return out.withColumn("precision", part("true_positive", "false_positive")).withColumn("recall", part("true_positive", "false_negative"))


def profile(events: DataFrame, name: str, start: Column, seconds: Column) -> DataFrame:
    """(name, calls, total, mean, longest, peak): calls by name and how many ran at once.

    Starts and ends are summed by second first, so the running number is over seconds, not over calls; a call that ends
    as another starts doesn't run with it.
    """
    s = start.cast("timestamp").cast("long")
    rows = events.select(F.col(name), s.alias("s"), (s + F.ceil(seconds)).alias("e"), seconds.alias("t"))
    steps = rows.select(name, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x")).groupBy(name, "x.at").agg(F.sum("x.d").alias("d"))
    running = F.sum("d").over(Window.partitionBy(name).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    peak = steps.withColumn("n", running).groupBy(name).agg(F.max("n").alias("peak"))
    return rows.groupBy(name).agg(F.count("*").alias("calls"), F.round(F.sum("t"), 3).alias("total"), F.round(F.avg("t"), 3).alias("mean"), F.round(F.max("t"), 3).alias("longest")).join(peak, name)


def store_status(stores: dict[str, tuple[DataFrame, str]], now: Column) -> DataFrame:
    """(store, n, latest, age_days) of stores given as (table, time column)."""
    one = [t.agg(F.count("*").alias("n"), F.max(c).alias("latest")).select(F.lit(s).alias("store"), "n", "latest", F.datediff(now, F.to_date("latest")).alias("age_days")) for s, (t, c) in stores.items()]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def once_per_value(df: DataFrame, column: str, result: str, f) -> DataFrame:
    """A costly column expression computed once for each distinct value of a column and joined back."""
    one = df.select(column).distinct().withColumn(result, f(column))
    return df.join(one, df[column].eqNullSafe(one[column]), "left").drop(one[column])

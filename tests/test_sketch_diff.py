import random

import pandas as pd
import pytest

from pyspark.sql import functions as F
from rxloom.operators.sketch_diff import compare_copies, differing_keys, estimated, sized, spark_hash, subtract, bucket_of

SCHEMA = "key long, a string, b int, extra string"


def brute(left, right):
    l, r = {x[0]: x[1:3] for x in left}, {x[0]: x[1:3] for x in right}
    out = []
    for k in l.keys() | r.keys():
        if k not in l:
            out.append((k, "missing_in_left"))
        elif k not in r:
            out.append((k, "missing_in_right"))
        else:
            out += [(k, f) for f, x, y in zip("ab", l[k], r[k]) if x != y]
    return sorted(out)


def test_hash_is_the_engines(spark):
    rng = random.Random(3)
    rows = [(rng.randint(-(2**63), 2**63 - 1), rng.randint(-(2**63), 2**63 - 1)) for _ in range(50)]
    got = spark.createDataFrame(rows, "k long, d long").select("k", "d", F.xxhash64(F.lit(77), "k", "d").alias("h")).collect()
    assert all(spark_hash(77, r.k, r.d) == r.h for r in got)


@pytest.mark.parametrize(("part", "size"), [(0.02, None), (0.9, None), (0.9, (8, 40)), (0.9, (4, 4))])
def test_few_and_many_differences(spark, part, size):
    """Tables sized by the estimate peel; of those given too few cells some peel when tried again, the rest go the exact way."""
    rng = random.Random(5)
    left = [(k, f"v{k}", k % 7, "x") for k in range(3000)]
    right = []
    for k, a, b, _ in left:
        u = rng.random()
        if u > part:
            right.append((k, a, b, "y"))
        elif u > part * 0.6:
            right.append((k, rng.choice([a, None, "w"]), rng.choice([b, None]), "y"))
    right += [(10_000 + k, None, None, None) for k in range(int(100 * part))]
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    got = compare_copies(l, r, ["a", "b"], size=size)
    assert sorted((x.key, x.difference) for x in got.collect()) == brute(left, right)


def test_peeling_says_when_it_failed(spark):
    l = spark.createDataFrame([(k, k) for k in range(2000)], "key long, digest long")
    none = l.limit(0)
    assert differing_keys(l, l, 4, 96).count() == 0
    whole = differing_keys(l, none, 64, 96).toPandas()
    assert whole["whole"].all() and set(whole["key"]) == set(range(2000)) and (whole["sign"] == 1).all()
    failed = differing_keys(l, none, 1, 96).toPandas()
    assert not failed["whole"].any() and pd.isna(failed["key"]).all()


def test_size_follows_the_difference(spark):
    def pairs(n, gone):
        a = spark.range(n).select(F.col("id").alias("key"), F.xxhash64("id").alias("digest"))
        return a, a.where(F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1000)) >= gone)

    for gone, want in ((0, 0), (1, 200), (10, 2000), (100, 20_000)):
        a, b = pairs(200_000, gone)
        got = estimated(a, b)
        assert want / 2 <= got <= want * 2, (want, got)
    a, b = pairs(200_000, 10)
    buckets, cells = sized(2000, 4)
    # of 1 % differences far fewer bytes than two columns of every row: 44 a cell against 16 a row of each copy
    assert subtract(a.repartition(4, "key"), b.repartition(4, "key"), bucket_of(buckets), cells).count() * 44 < 0.1 * 400_000 * 16
    assert sized(0, 4) == (4, 4) and sized(10_000, 4)[0] % 4 == 0
    # a bucket lies in one partition of rows hashed by key
    at = a.repartition(4, "key").select(F.spark_partition_id().alias("p"), bucket_of(buckets).alias("b")).groupBy("b").agg(F.count_distinct("p").alias("n"))
    assert at.where("n > 1").count() == 0


def test_empty_copies(spark):
    e = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert compare_copies(e, e, ["a", "b"]).count() == 0
    assert [x.difference for x in compare_copies(one, e, ["a", "b"]).collect()] == ["missing_in_right"]
    assert compare_copies(one, one, ["a", "b"]).count() == 0

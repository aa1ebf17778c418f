import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from rxloom.llm.mixing import leaf_budgets, mix_choice, share_report
from rxloom.llm.packing import SLACK, even_steps, pack_documents, pack_tiers, packing_report
from rxloom.llm.tokens import with_token_counts

PACKS = [("s", 16), ("m", 64), ("l", 256)]


@pytest.mark.parametrize("mixed", [False, True])
def test_every_token_is_placed_once(spark, mixed):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 0, 1, 5, 16, 17, 63, 64, 255, 256, 300, 1024, rng.randint(1, 700)]), "x") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, pack_name string")
    got = pack_documents(df, PACKS, mixed, shard_rows=150).toPandas()
    sizes = {i: n for i, n, _ in rows if n is not None}
    for goal, part in [("all", got)] if mixed else got.groupby("pack_name"):
        assert set(part["doc_id"]) == set(sizes)
        assert part.groupby("doc_id")["n_tokens"].sum().to_dict() == sizes
        for doc, p in part.groupby("doc_id"):
            p = p.sort_values("piece_no")
            assert p["start_token"].tolist() == [0, *np.cumsum(p["n_tokens"])[:-1]]
            if len(p) > 1:
                assert sizes[doc] > (256 if mixed else dict(PACKS)[goal])
    key = ["pack_name", "container_id"]
    load = got.groupby(key).agg(t=("n_tokens", "sum"), cap=("capacity_tokens", "first"), u=("unused_tokens", "first"), n=("position_no", "nunique"), k=("position_no", "size"))
    assert (load.t <= load.cap).all() and (load.cap - load.t == load.u).all() and (load.n == load.k).all()


def test_little_space_is_lost(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(200)) + 1).alias("n_tokens"))
    r = packing_report(pack_documents(df, [("l", 256)])).first()
    assert r.unused_share < 0.01
    assert pack_documents(df.limit(0), PACKS).count() == 0


def test_tiers_and_steps():
    where, caps = pack_tiers(np.array([10, 6, 4, 3]), [10])
    assert where.tolist() == [0, 1, 1, 2] and caps.tolist() == [10, 10, 10]
    # the 3 fills the gap of the longer tier; the second 4 has a container of its own tier
    where, caps = pack_tiers(np.array([10, 7, 4, 3]), [4, 10])
    assert where.tolist() == [0, 1, 2, 1] and caps.tolist() == [10, 10, 4]
    # two of 3 leave a quarter of their short containers unused: the longer tier takes them
    where, caps = pack_tiers(np.array([10, 4, 3, 3]), [4, 10])
    assert where.tolist() == [0, 1, 2, 2] and caps.tolist() == [10, 4, 10]
    s = even_steps(np.arange(64), np.full(64, 100))
    assert np.ptp([np.arange(64)[s == k].sum() for k in range(8)]) == 0


def test_tiers_keep_only_full_short_containers():
    rng = np.random.default_rng(5)
    sizes = np.sort(np.minimum(rng.lognormal(4, 1, 6000).astype(np.int64) + 1, 1024))[::-1]
    where, caps = pack_tiers(sizes, [64, 256, 1024])
    load = np.bincount(where, weights=sizes)
    assert (load <= caps).all() and set(caps) == {64, 256, 1024} and ((caps - load)[caps < 1024] <= SLACK * caps[caps < 1024]).all()
    assert (caps.sum() - load.sum()) / caps.sum() < 0.0017
    assert len(caps) != len(pack_tiers(sizes, [1024])[1])


TREE = {"monograph": "label", "leaflet": "label", "market_note": "market"}


def test_budgets_redistribute_to_siblings_first():
    targets = [("m", "monograph", 0.5, 1), ("m", "leaflet", 0.2, 5), ("m", "market_note", 0.3, 5)]
    sums = {("monograph", "en"): 100, ("leaflet", "en"): 1000, ("market_note", "en"): 1000}
    got = {r[1]: r[4] for r in leaf_budgets(targets, sums, total=1000, domains=TREE)}
    assert got == pytest.approx({"monograph": 100, "leaflet": 600, "market_note": 300})
    got = {r[1]: r[4] for r in leaf_budgets(targets, {**sums, ("leaflet", "en"): 20}, total=1000, domains=TREE)}
    assert got == pytest.approx({"monograph": 100, "leaflet": 100, "market_note": 800})


def test_choice(spark):
    rows = [(i, "ab"[i % 2] if i % 10 else None, ["EN", "fr", None][i % 3], 10 + i % 7, 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long, times int")
    targets = spark.createDataFrame([("m", "a", 0.7, 3), ("m", "b", 0.2, 1), ("m", "gone", 0.1, 9), ("n", "b", 1.0, 2)], "mix_name string, source string, target_share double, max_repeats int")
    got = mix_choice(docs, targets, total=30_000, cell_bits=3).toPandas()
    assert (got.groupby(["mix_name", "doc_id"]).size() == 1).all()
    assert (got.times >= 1).all() and got[(got.mix_name == "m") & (got.source == "a")].times.max() <= 3 and got[(got.mix_name == "m") & (got.source == "b")].times.max() == 1
    rep = {(r.mix_name, r.source): r for r in share_report(mix_choice(docs, targets, total=30_000, cell_bits=3), targets).collect()}
    assert rep["m", "gone"].tokens == 0 and sum(r.actual_share for k, r in rep.items() if k[0] == "m") == pytest.approx(1, abs=1e-5)
    assert 30_000 - 6 * 17 <= sum(r.tokens for k, r in rep.items() if k[0] == "m") <= 30_000
    again = mix_choice(docs.repartition(7), targets, total=30_000, cell_bits=3).toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, got.values.tolist()))
    assert mix_choice(docs.limit(0), targets).count() == 0
    for bits in (1, 10):  # cells only bound the work: the order drawn and so the choice are the same
        assert sorted(map(tuple, mix_choice(docs, targets, total=30_000, cell_bits=bits).toPandas().values.tolist())) == sorted(map(tuple, got.values.tolist()))


def test_reachable_total(spark):
    targets = [("m", "a", 0.5, 2), ("m", "b", 0.5, 1)]
    sums = {("a", "en"): 100, ("b", "en"): 1000, ("b", "fr"): 200}
    got = leaf_budgets(targets, sums, total="reachable")
    assert {(r[1], r[2]): round(r[4], 6) for r in got} == {("a", "en"): 200, ("b", "en"): pytest.approx(200 * 1000 / 1200), ("b", "fr"): pytest.approx(200 * 200 / 1200)}


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 5), (3, None, 5)], "doc_id long, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in with_token_counts(df).collect()} == {1: 2, 2: 0, 3: None}

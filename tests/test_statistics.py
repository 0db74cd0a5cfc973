import random
import statistics as py

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgertide.functions import stats


def test_distribution_of_the_hand_sample(spark):
    df = spark.createDataFrame([("a", v) for v in (-0.10, 0.0, 0.10, 0.90, None)], "k string, x double")
    for result in (stats.distribution(df, ["k"], "x"), stats.bounded_distribution(df, ["k"], "x")):
        row = result.first()
        assert (row["n"], row["up"], row["flat"]) == (4, 2, 1)
        for name, value in {"min": -0.10, "q25": -0.025, "median": 0.05, "mean": 0.225, "q75": 0.30, "max": 0.90}.items():
            assert row[name] == pytest.approx(value)


def test_wilson_interval(spark):
    low, high = stats.wilson(F.col("u"), F.col("n"))
    rows = spark.createDataFrame([(6, 8), (0, 5), (5, 5), (0, 0)], "u int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert (round(rows[0]["l"], 3), round(rows[0]["h"], 3)) == (0.409, 0.929)
    assert rows[1]["l"] == 0 and rows[2]["h"] == 1 and rows[3]["l"] is None


def test_quantiles_and_ranks_of_a_hot_group_with_ties(spark):
    rng = random.Random(7)
    rows = [("hot", round(rng.gauss(0, 1), 1) if i % 3 else 0.0, i) for i in range(3000)] + [("small", rng.random(), 10000 + i) for i in range(5)] + [("one", 4.0, 1)]
    df = spark.createDataFrame(rows, "k string, x double, pos int")
    got = {r["k"]: r for r in stats.describe(df, ["k"], "x").collect()}
    for key in ("hot", "small", "one"):
        values = [x for k, x, _ in rows if k == key]
        assert [got[key][q] for q in ("q25", "q50", "q75")] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))
        assert got[key]["mean"] == pytest.approx(py.fmean(values)) and got[key]["n"] == len(values)
    ranks = {(r["k"], r["pos"]): r for r in stats.distributed_ranks(df, ["k"], "x", "pos").collect()}
    for key in ("hot", "small", "one"):
        members = [(x, p) for k, x, p in rows if k == key]
        for i, (_, p) in enumerate(sorted(members), 1):
            assert ranks[key, p]["rank_asc"] == i
        for i, (_, p) in enumerate(sorted(members, key=lambda m: (-m[0], m[1])), 1):
            assert ranks[key, p]["rank_desc"] == i


def test_drawdown_needs_every_price(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 12.0), ("a", 3, 9.0), ("b", 1, 5.0), ("b", 2, None)], "s string, t int, p double")
    got = {r["s"]: r["max_drawdown"] for r in stats.max_drawdown(df, ["s"], "t", "p").collect()}
    assert got["a"] == pytest.approx(0.25) and got["b"] is None


def test_buckets_grow_with_the_value(spark):
    rng = random.Random(2)
    values = sorted([0.0, -0.0, 5e-324, -5e-324, 1.0, 2.0, 4.0, 1.7976931348623157e308, -1.7976931348623157e308, float("inf"), float("-inf")]
                    + [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-300, 300) for _ in range(2000)] + [2.0**e * (1 + d) for e in range(-20, 20) for d in (-1e-16, 0, 1e-15)])
    got = [r["b"] for r in spark.createDataFrame([(x,) for x in values], "x double").coalesce(1).select("x", stats.bucket_of(F.col("x")).alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 1500


def test_a_ticker_with_most_events_is_no_single_task(spark):
    """Nine tenths of the rows in one group: where rows are joined, no key takes them to one task."""
    rng = random.Random(11)
    rows = [("hot" if i % 10 else f"t{i % 70}", rng.gauss(0, 0.05), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "ticker string, x double, pos long")
    dealt = df.select("ticker", stats.bucket_of(F.col("x")).alias("b")).groupBy(F.pmod(F.hash("ticker", "b"), F.lit(16)).alias("task")).count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 20_000 / 5
    boxes = stats.distribution(df, ["ticker"], "x")
    beyond = stats.outliers(df, ["ticker"], "x", boxes).collect()
    fences = {r["ticker"]: (r["whisker_low"], r["whisker_high"]) for r in boxes.collect()}
    for ticker, (low, high) in fences.items():
        own = np.array([x for t, x, _ in rows if t == ticker])
        q1, q3 = np.quantile(own, [0.25, 0.75])
        inside = own[(own >= q1 - 1.5 * (q3 - q1)) & (own <= q3 + 1.5 * (q3 - q1))]
        assert (low, high) == pytest.approx((inside.min(), inside.max()))
    assert sorted(r["pos"] for r in beyond) == sorted(p for t, x, p in rows if not fences[t][0] <= x <= fences[t][1]) and beyond

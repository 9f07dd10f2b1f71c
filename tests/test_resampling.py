"""Bootstrap of fixed size and the exact two-sample test against plain versions."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plumbline.operators.resample import cluster_bootstrap, fixed_bootstrap
from plumbline.operators.selection import path_tail, two_sample_ks


def test_each_replicate_draws_as_many_clusters_as_there_are(spark):
    rows = spark.range(3000).select((F.col("id") % 300).alias("c"), F.sqrt("id").alias("v"))
    one = {"n": F.lit(1)}
    for slot in (20_000, 40, 1):
        got = fixed_bootstrap(rows.dropDuplicates(["c"]), "c", one, F.col("n"), 50, 7, slot=slot).first()
        assert (got["mean"], got["low"], got["high"], got["std"]) == (300.0, 300.0, 300.0, 0.0)
    assert cluster_bootstrap(rows.dropDuplicates(["c"]), "c", one, F.col("n"), 50, 7).first()["std"] > 0  # Poisson draws vary in number


def test_it_spreads_as_drawing_with_replacement_does(spark):
    rows = spark.range(400).select("id", F.pow(F.col("id") % 20, F.lit(2)).cast("double").alias("v"))
    values = [(i % 20) ** 2 for i in range(400)]
    mean = sum(values) / 400
    spread = (sum((v - mean) ** 2 for v in values) / 400 / 400) ** 0.5
    parts, measure = {"v": F.col("v"), "n": F.lit(1)}, F.col("v") / F.col("n")
    for slot in (20_000, 50):
        got = fixed_bootstrap(rows, "id", parts, measure, 2000, 3, slot=slot).first()
        assert got["mean"] == pytest.approx(mean, abs=4 * spread / 2000**0.5)
        assert got["std"] == pytest.approx(spread, rel=0.08)
        assert got["low"] == pytest.approx(mean - 1.96 * spread, abs=0.25 * spread) and got["high"] == pytest.approx(mean + 1.96 * spread, abs=0.25 * spread)
        again = fixed_bootstrap(rows.repartition(7), "id", parts, measure, 2000, 3, slot=slot).first()
        assert again["std"] == pytest.approx(got["std"], rel=1e-12)
    none = fixed_bootstrap(rows.limit(0), "id", parts, measure, 5, 3).first()
    assert none["mean"] is None


def count_paths(far, n, m):
    hit = total = 0
    for pick in combinations(range(n + m), n):
        x, worst = 0, 0
        for i in range(n + m):
            x += i in pick
            worst = max(worst, abs(x * m - (i + 1 - x) * n))
        hit, total = hit + (worst >= far), total + 1
    return hit / total


@pytest.mark.parametrize("n,m", [(1, 1), (3, 4), (5, 5), (6, 3)])
def test_tail_is_the_share_of_orders(n, m):
    for far in range(n * m + 1):
        assert path_tail(far / (n * m), n, m) == pytest.approx(count_paths(far, n, m), abs=1e-12)


def exact_tail(far, n, m):
    near = [int(y * n < far) for y in range(m + 1)]
    for x in range(1, n + 1):
        below = 0
        for y in range(m + 1):
            below = near[y] = (near[y] + below) * (abs(x * m - y * n) < far)
    return 1 - near[m] / math.comb(n + m, m)


def test_tail_of_larger_samples():
    for n, m in ((400, 60), (60, 400), (150, 149)):
        for d in (0.05, 0.11, 0.2, 0.4):
            far = round(d * n * m)
            assert path_tail(far / (n * m), n, m) == pytest.approx(exact_tail(far, n, m), abs=1e-9)
    for d, n, m in ((0.03, 5000, 4000), (0.02, 10_000, 9000), (0.1, 700, 700)):
        root = (n * m / (n + m)) ** 0.5 * d
        series = sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * root * root) for k in range(1, 60))
        assert path_tail(d, n, m) == pytest.approx(series, rel=0.1)
    assert path_tail(0.5, 10_000, 10_000) < 1e-9 and path_tail(0.1, 100, 100) == pytest.approx(0.70205698, abs=1e-8)


def test_two_samples(spark):
    rows = spark.createDataFrame([(float(v), False) for v in (1, 2, 3, 4, 5)] + [(float(v), True) for v in (4, 5, 6, 7)], "x double, t boolean")
    got = two_sample_ks(rows, "x", "t").first()
    assert got.statistic == pytest.approx(0.6) and got.p == pytest.approx(count_paths(12, 5, 4))
    alike = two_sample_ks(spark.range(200).select((F.col("id") % 100).cast("double").alias("x"), (F.col("id") < 100).alias("t")), "x", "t").first()
    assert (alike.statistic, alike.p) == (0.0, 1.0)
    large = two_sample_ks(spark.range(24_000).select(F.xxhash64("id").cast("double").alias("x"), (F.col("id") < 12_000).alias("t")), "x", "t").first()
    assert 0.001 < large.p <= 1
    one = two_sample_ks(rows.where("t"), "x", "t").first()
    assert one.statistic is None and one.p is None

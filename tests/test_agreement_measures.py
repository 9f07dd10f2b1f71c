"""Correlations, their p-values and kappa against plain versions and published critical values."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as M


def plain_ranks(x):
    order = sorted(x)
    first = {}
    for i, v in enumerate(order):
        first.setdefault(v, i)
    count = {v: order.count(v) for v in set(x)}
    return [first[v] + (count[v] + 1) / 2 for v in x]


def t_tail(r, n):
    """Two-sided p by integrating Student's density."""
    free, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
    u = np.linspace(0, math.atan(t / math.sqrt(free)), 200_001)  # t = sqrt(free) tan u
    inner = np.cos(u) ** (free - 1)
    front = math.exp(math.lgamma((free + 1) / 2) - math.lgamma(free / 2)) / math.sqrt(math.pi)
    return 1 - 2 * front * float(((inner[1:] + inner[:-1]) / 2 * np.diff(u)).sum())


def p_of(spark, r, n):
    return spark.createDataFrame([(r, n)], "r double, n bigint").select(M.correlation_p(F.col("r"), F.col("n")).alias("p")).first().p


@pytest.mark.parametrize("r,n,p", [(0.8783, 5, 0.05), (0.9587, 5, 0.01), (0.3610, 30, 0.05), (0.4629, 30, 0.01), (0.1946, 102, 0.05)])
def test_published_critical_values(spark, r, n, p):
    assert p_of(spark, r, n) == pytest.approx(p, rel=2e-3)
    assert p_of(spark, -r, n) == p_of(spark, r, n)


@pytest.mark.parametrize("n", [3, 4, 5, 12, 30, 1001])
def test_tail_equals_the_integral(spark, n):
    for r in (1e-6, 0.01, 0.2, 0.55, 0.93):
        assert p_of(spark, r, n) == pytest.approx(t_tail(r, n), abs=1e-8)


@pytest.mark.parametrize("n", [100_000, 10_000_000, 1_000_000_000])
def test_tail_of_many_rows_nears_the_normal(spark, n):
    """The normal tail and the first term of its expansion in 1 / n."""
    for z in (0.1, 1.0, 1.959964, 3.5):
        r = z / math.sqrt(n - 2 + z * z)
        first = (z**3 + z) * NormalDist().pdf(z) / (2 * (n - 2))
        assert p_of(spark, r, n) == pytest.approx(2 * NormalDist().cdf(-z) + first, rel=2e-6)


def test_edges_of_the_tail(spark):
    assert [p_of(spark, *x) for x in ((1.0, 9), (-1.0, 9), (0.0, 9), (1.0, 2), (0.5, 1), (None, 9))] == [0.0, 0.0, 1.0, 1.0, None, None]


def test_agreement_of_many_valued_columns(spark):
    rng = random.Random(4)
    x = [rng.randint(0, 9) for _ in range(300)]
    y = [min(9, max(0, v + rng.randint(-3, 3))) ** 2 if rng.random() < 0.7 else v for v in x]
    rows = [*zip(x, y), (None, 1), (2, None)]
    got = M.agreement(spark.createDataFrame(rows, "x int, y int"), "x", "y").first()
    rate = sum(a == b for a, b in zip(x, y)) / 300
    chance = sum(x.count(v) * y.count(v) for v in set(x)) / 300**2
    assert (got.n, got.rate) == (300, pytest.approx(rate))
    assert got.kappa == pytest.approx((rate - chance) / (1 - chance))
    assert got.pearson == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert got.spearman == pytest.approx(np.corrcoef(plain_ranks(x), plain_ranks(y))[0, 1])
    assert abs(got.spearman - got.pearson) > 1e-3  # the one is no other name for the other
    assert got.pearson_p == pytest.approx(p_of(spark, got.pearson, 300)) and got.spearman_p < 1e-20


def test_agreement_of_constant_single_and_no_rows(spark):
    of = lambda rows: tuple(M.agreement(spark.createDataFrame(rows, "x int, y int"), "x", "y").first())
    assert of([(1, 1)] * 5) == (5, 1.0, 1.0, None, None, None, None)
    assert of([(1, 0)]) == (1, 0.0, 0.0, None, None, None, None)
    assert of([(None, 0)]) == (0, None, None, None, None, None, None)
    assert of([(0, 0), (1, 1)])[3:] == (1.0, 1.0, 1.0, 1.0)


def test_double_annotated_needs_ten(spark):
    rows = [("Contradicted", "Contradicted "), ("Supported", "Supported"), ("Contradicted", "Supported")] * 4
    of = lambda rows: M.double_annotated(spark.createDataFrame(rows, "a string, b string"), "a", "b", ("Contradicted",)).first()
    got = of([*rows, ("Supported", " "), ("Supported", None)])
    assert (got.n_double, got.status, got.rate) == (12, "computed", pytest.approx(2 / 3))
    assert got.kappa == pytest.approx((2 / 3 - 4 / 9) / (1 - 4 / 9))
    assert tuple(of(rows[:9])) == (9, None, None, "insufficient")

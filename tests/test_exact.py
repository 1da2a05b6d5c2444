"""Statistics against exact integer arithmetic and closed forms."""

import math
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions import exact


def test_log_gamma():
    for x in [1, 2, 3, 10, 50, 170, 1000]:
        assert abs(exact.log_gamma(np.array([float(x)]))[0] - math.log(math.factorial(x - 1))) <= 1e-12 * max(1, math.log(math.factorial(x - 1)) if x > 2 else 1)
    for x in [1e-8, 0.5, 1.5, 7.25, 11.999, 12.001, 1e7]:
        assert math.isclose(exact.log_gamma(np.array([x]))[0], math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12)


def test_gamma_is_the_poisson_sum():
    # For whole a, Q(a, x) is the chance of fewer than a events where x are expected.
    for a in (1, 2, 5, 20, 60):
        for x in (0.1, 1.0, 4.5, 19.0, 33.3, 80.0):
            q = math.fsum(math.exp(-x + k * math.log(x) - math.lgamma(k + 1)) for k in range(a))
            assert abs(exact.gamma_q(a, x) - q) < 1e-12 and abs(exact.gamma_p(a, x) - (1 - q)) < 1e-12
    assert exact.gamma_q(5, 400.0) > 0 and np.isnan(exact.gamma_p(-1, 1.0)) and exact.gamma_p(2, 0.0) == 0


def test_beta_is_the_binomial_sum():
    for a, b in [(1, 1), (2, 5), (7, 3), (30, 40), (1, 60)]:
        for x in (Fraction(1, 100), Fraction(1, 3), Fraction(1, 2), Fraction(97, 100)):
            n = a + b - 1
            wanted = sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))
            assert abs(exact.beta(a, b, float(x)) - float(wanted)) < 1e-12
    assert np.isnan(exact.beta(1, 1, 1.5)) and exact.beta(3, 4, 0.0) == 0 and exact.beta(3, 4, 1.0) == 1


def plain_fisher(a, b, c, d):
    r, k, n = a + b, a + c, a + b + c + d
    p = {i: Fraction(math.comb(k, i) * math.comb(n - k, r - i), math.comb(n, r)) for i in range(max(0, r + k - n), min(r, k) + 1)}
    return [float(x) for x in (p[a], sum(v for i, v in p.items() if i <= a), sum(v for i, v in p.items() if i >= a), sum(v for v in p.values() if v <= p[a]))]


def test_fisher(spark):
    rng = random.Random(3)
    rows = [(0, 0, 0, 0), (3, 1, 1, 3), (0, 5, 5, 0), (12, 0, 7, 4), (500, 300, 200, 400), (1, 900, 3, 800)] + [tuple(rng.randrange(60) for _ in range(4)) for _ in range(60)]
    frame = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)] + [(None, 1, 1, 1, 900), (-1, 1, 1, 1, 901)], "a int, b int, c int, d int, k int")
    got = {r.k: r.f for r in frame.select("k", exact.fisher_of(*map(F.col, "abcd")).alias("f")).collect()}
    for k, r in enumerate(rows):
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[k], plain_fisher(*r), strict=True)), r
    assert got[900] is None and got[901] is None


def test_columns(spark):
    r = spark.range(1).select(exact.log_gamma_of(F.lit(5)).alias("l"), exact.gamma_p_of(F.lit(2.0), F.lit(1.0)).alias("p"), exact.gamma_q_of(F.lit(2.0), F.lit(1.0)).alias("q"), exact.beta_of(F.lit(2), F.lit(3), F.lit(0.5)).alias("b"), *(exact.erfc_of(F.lit(float(x))).alias(f"e{k}") for k, x in enumerate((-2, 0, 0.5, 5)))).first()
    assert math.isclose(r.l, math.log(24)) and math.isclose(r.p + r.q, 1) and math.isclose(r.b, 11 / 16)
    assert all(math.isclose(r[f"e{k}"], math.erfc(x), rel_tol=1e-12) for k, x in enumerate((-2, 0, 0.5, 5)))

"""Tail probabilities as column expressions (binomial sign test, Student t)."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, functions as F

from concord.functions.columns import _c, Col


def _stirling_error(n: Column) -> Column:
    """ln(n!) minus Stirling's formula: exact sum when small, series when large."""
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(20)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda s, k: s + F.ln(k.cast("double")),
    ) - F.when(
        n > 0, (n + 0.5) * F.ln(n) - n + F.lit(0.5 * math.log(2 * math.pi))
    ).otherwise(F.lit(0.0))
    inv = F.lit(1.0) / F.greatest(n, F.lit(1.0))
    series = inv / 12.0 - F.pow(inv, 3) / 360.0 + F.pow(inv, 5) / 1260.0 - F.pow(inv, 7) / 1680.0
    return F.when(n > 20, series).otherwise(small)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x/mean) + mean - x, written around the ratio so near values cancel."""
    e = (x - mean) / mean
    return F.when(x > 0, mean * ((e + 1.0) * F.log1p(e) - e)).otherwise(mean)


def sign_test(n01: Col, n10: Col) -> Column:
    """Two-sided p that both directions are equally likely; 1 without discordance.

    The lower tail is summed downward from its largest term. Terms shrink at
    least geometrically once past a few standard deviations, so the sum needs
    O(sqrt(n)) terms however large the counts are.
    """
    a, b = _c(n01).cast("double"), _c(n10).cast("double")
    n, lo = a + b, F.least(a, b)
    half, hi = n / 2.0, F.greatest(a, b)
    log_top = (
        _stirling_error(n) - _stirling_error(lo) - _stirling_error(hi)
        - _deviance(lo, half) - _deviance(hi, half)
        + F.when(lo > 0, 0.5 * F.ln(n / (F.lit(2 * math.pi) * lo * hi))).otherwise(F.lit(0.0))
    )
    terms = F.least(lo, F.ceil(F.sqrt(n)) * 20 + 40).cast("int")
    tail = F.aggregate(
        F.sequence(F.lit(0), terms),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, j: F.struct(
            (acc["t"] * (lo - j) / (hi + j + 1.0)).alias("t"), (acc["s"] + acc["t"]).alias("s")
        ),
        lambda acc: acc["s"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * F.exp(log_top) * tail))


def student_t_p(t: Col, df: Col, steps: int = 2000) -> Column:
    """Two-sided p of a t statistic.

    With x = sqrt(df) tan(u) the density becomes cos(u)**(df-1) on [0, pi/2),
    so both the wanted area and its normaliser are smooth Simpson sums.
    """
    df = _c(df).cast("double")
    top = F.atan(F.abs(_c(t)) / F.sqrt(df))

    def area(upper: Column) -> Column:
        h = upper / float(steps)
        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(steps)),
            F.lit(0.0),
            lambda s, k: s
            + F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
            * F.pow(F.cos(k * h), df - 1.0),
        )
        return total * h / 3.0

    whole = area(F.lit(math.pi / 2))
    return F.greatest(F.lit(0.0), F.lit(1.0) - area(top) / whole)


def _t_two_sided(t: float, df: int, steps: int = 400) -> float:
    top = math.atan(abs(t) / math.sqrt(df))

    def area(upper: float) -> float:
        h = upper / steps
        return h / 3 * sum(
            (1 if k in (0, steps) else 4 if k % 2 else 2) * math.cos(k * h) ** (df - 1)
            for k in range(steps + 1)
        )

    return 1 - area(top) / area(math.pi / 2)


@lru_cache
def t_quantiles_95(upto: int = 40) -> tuple[float, ...]:
    """Multipliers of 95% two-sided t intervals for 1..upto degrees of freedom."""
    def one(df: int) -> float:
        lo, hi = 1.9, 13.0
        for _ in range(45):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _t_two_sided(mid, df) > 0.05 else (lo, mid)
        return (lo + hi) / 2

    return tuple(one(df) for df in range(1, upto + 1))


def t_multiplier_95(df: Col, upto: int = 40) -> Column:
    """The multiplier for any degrees of freedom: a generated table, then the
    expansion around the normal quantile, which is exact to 1e-8 from there on."""
    d = _c(df)
    table = F.array(*[F.lit(q) for q in t_quantiles_95(upto)])
    z = 1.959963984540054
    terms = (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )
    x = d.cast("double")
    far = F.lit(z)
    for power, term in enumerate(terms, start=1):
        far = far + F.lit(term) / F.pow(x, power)
    return F.when(d.between(1, upto), F.element_at(table, F.greatest(F.least(d, F.lit(upto)), F.lit(1)).cast("int"))).when(d > upto, far)

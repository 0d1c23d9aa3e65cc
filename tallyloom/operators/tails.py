"""Tails of the F, t and chi-squared laws as column expressions (T04, T05, T12): continued fractions and series as folds of fixed length, so nothing leaves the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.operators.schema import let

#: Steps of a fraction or series. They converge in about the root of the degrees of freedom, so these serve up to some 100,000; further steps change nothing.
STEPS = 1000
TINY = 1e-300
# Lanczos' coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(z: Column) -> Column:
    """For z of a half or more."""
    total = sum((F.lit(c) / (z + F.lit(i - 1.0)) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + F.lit(6.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (z - F.lit(0.5)) * F.log(t) - t + F.log(total)


def _sound(x: Column) -> Column:
    return F.when(F.abs(x) > TINY, x).otherwise(F.lit(TINY))


def _state(c: Column, d: Column, h: Column) -> Column:
    return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))


def _lentz(state: Column, top: Column, base: Column) -> Column:
    """One step of the modified Lentz method: base + top / ..."""
    return let(F.struct(_sound(base + top / state["c"]).alias("c"), (F.lit(1.0) / _sound(base + top * state["d"])).alias("d")), lambda n: _state(n["c"], n["d"], state["h"] * n["c"] * n["d"]))


def _beta_part(p: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b) for x on the side where the fraction converges fast; p: struct a, b, x."""
    a, b, x = p["a"], p["b"], p["x"]
    first = F.lit(1.0) / _sound(F.lit(1.0) - (a + b) * x / (a + 1))

    def step(state: Column, i: Column) -> Column:
        m = i.cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(_lentz(state, even, F.lit(1.0)), lambda s: _lentz(s, odd, F.lit(1.0)))

    h = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _state(F.lit(1.0), first, first), step)["h"]
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return front * h / a


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    swap = x >= (a + 1) / (a + b + 2)
    p = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x"))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).when(swap, 1 - let(p, _beta_part)).otherwise(let(p, _beta_part))


def f_tail(f: Column, d1: Column, d2: Column) -> Column:
    """Probability that F with d1 and d2 degrees of freedom exceeds f; 1 for f of 0 or less, 0 for infinity, null or NaN as they come."""
    f, d1, d2 = (c.cast("double") for c in (f, d1, d2))
    return F.when(F.isnan(f), f).when(f <= 0, 1.0).when(f == float("inf"), 0.0).when(f.isNotNull(), incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic, by F with one degree of freedom between."""
    return f_tail(t * t, F.lit(1.0), df)


def chi2_tail(x: Column, k: Column) -> Column:
    """Probability that chi squared with k degrees of freedom exceeds x; 1 for x of 0 or less."""

    def tail(p: Column) -> Column:
        a, half = p["a"], p["x"]
        front = F.exp(-half + a * F.log(half) - log_gamma(a))
        terms = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct((1 / a).alias("term"), (1 / a).alias("sum")), lambda s, i: let(s["term"] * half / (a + i), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum"))))
        base, first = half + 1 - a, F.lit(1.0) / _sound(half + 1 - a)
        fraction = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), _state(F.lit(1 / TINY), first, first), lambda s, i: _lentz(s, -i.cast("double") * (i - a), base + 2 * i))
        return F.when(half < a + 1, 1 - front * terms["sum"]).otherwise(front * fraction["h"])

    x, k = x.cast("double"), k.cast("double")
    return F.when(F.isnan(x), x).when(x <= 0, 1.0).when(x == float("inf"), 0.0).when(x.isNotNull(), let(F.struct((k / 2).alias("a"), (x / 2).alias("x")), tail))

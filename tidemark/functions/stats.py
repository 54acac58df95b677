"""Rates, intervals and ranks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the normal quantile at 0.975.
Z95 = 1.959963984540054


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rate(flag: Column, among: Column | None = None) -> Column:
    """Aggregate: the share of rows (among those of a condition) with the flag; 0 without rows."""
    value = F.coalesce(flag.cast("boolean"), F.lit(False)).cast("double")
    return F.coalesce(F.avg(value if among is None else F.when(among, value)), F.lit(0.0))


def mean(value: Column, among: Column | None = None) -> Column:
    return F.coalesce(F.avg(value if among is None else F.when(among, value)), F.lit(0.0))


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of Wilson's interval for a rate; (0, 0) without trials."""
    n = F.greatest(total, F.lit(1)).cast("double")
    p = successes / n
    scale = 1 + F.lit(z * z) / n
    middle = (p + F.lit(z * z / 2) / n) / scale
    half = z * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n)) / scale
    none = total <= 0
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), middle + half))


def agresti_caffo(s1: Column, n1: Column, s2: Column, n2: Column, z: float = Z95) -> tuple[Column, Column]:
    """Low and high end of the adjusted interval for the difference of two rates; (0, 0) if a side has no trials."""
    a, b = (s1 + 1) / (n1 + 2), (s2 + 1) / (n2 + 2)
    half = z * F.sqrt(F.greatest(a * (1 - a) / (n1 + 2) + b * (1 - b) / (n2 + 2), F.lit(0.0)))
    none = (n1 <= 0) | (n2 <= 0)
    return F.when(none, 0.0).otherwise(F.greatest(F.lit(-1.0), a - b - half)), F.when(none, 0.0).otherwise(F.least(F.lit(1.0), a - b + half))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    return F.when(x > 30, x).otherwise(F.log1p(F.exp(x)))


def random_top_k(true: Column, pool: Column, k: int) -> Column:
    """Chance that a random order of the pool has a true item among its first k."""
    n, t = pool.cast("int"), true.cast("int")
    top = F.least(F.lit(k), n)
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0))), F.lit(1.0), lambda acc, i: acc * (n - t - i) / (n - i))
    return F.when((n <= 0) | (t <= 0), 0.0).when((t >= n) | (n - t < top), 1.0).otherwise(1 - miss)


def random_reciprocal_rank(true: Column, pool: Column) -> Column:
    """Expected reciprocal rank of the first true item of a random order."""
    n, t = pool.cast("int"), true.cast("int")
    # P(first at r) follows from P(first at r - 1) by (n - r - t + 2) / (n - r + 1)
    start = F.struct((t / n).alias("p"), (t / n).alias("sum"))

    def step(acc: Column, r: Column) -> Column:
        p = acc.p * (n - r - t + 2) / (n - r + 1)
        return F.struct(p.alias("p"), (acc.sum + p / r).alias("sum"))

    ranks = F.when(n - t + 1 >= 2, F.sequence(F.lit(2), n - t + 1)).otherwise(F.array().cast("array<int>"))
    return F.when((n <= 0) | (t <= 0), 0.0).otherwise(F.aggregate(ranks, start, step, lambda acc: acc.sum))


def half_width(values: str, z: float = 1.96, three: float = 4.303) -> Column:
    """Aggregate: half the interval of a mean, by Student's t for three values and the normal beyond; 0 for one."""
    n = F.count(values)
    return F.when(n < 2, 0.0).otherwise(F.when(n == 3, three).otherwise(z) * F.stddev_samp(values) / F.sqrt(n.cast("double")))


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(F.lit(20.0), loss))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, floor: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(floor)) * F.greatest(F.sqrt(dot(b, b)), F.lit(floor)))

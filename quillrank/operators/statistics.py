"""Significance tests between two algorithms' fold results, and popularity statistics; numpy only."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.operators.prep import gini


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """By bisection of the distribution function, to double precision."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised; continued fraction by Lentz's method."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        num = 1.0 if i == 0 else (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def shapiro(x) -> tuple[float, float]:
    """W and p by Royston's approximation (3 to 5000 values)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = a[-1] + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
        if n > 5:
            prev = a[-2] + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * prev**2)
            a = m / math.sqrt(phi)
            a[-1], a[0], a[-2], a[1] = last, -last, prev, -prev
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if g <= math.log(1 - w + 1e-300):
            return w, 0.0
        y = -math.log(g - math.log(1 - w + 1e-300))
        mean, sd = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3, math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        y, k = math.log(1 - w + 1e-300), math.log(n)
        mean, sd = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3, math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return w, 1 - normal_cdf((y - mean) / sd)


def dagostino(x) -> float:
    """p of the omnibus test of skewness and kurtosis (8 values or more)."""
    x = np.asarray(x, float)
    n, d = len(x), x - x.mean()
    m2 = (d**2).mean()
    if m2 == 0:
        return 1.0
    skew, kurt = (d**3).mean() / m2**1.5, (d**4).mean() / m2**2
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + math.sqrt(2 * (b2 - 1))
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    e, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    s = (kurt - e) / math.sqrt(var)
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / b1 * (2 / b1 + math.sqrt(1 + 4 / b1**2))
    t = (1 - 2 / a) / (1 + s * math.sqrt(2 / (a - 4)))
    z2 = ((1 - 2 / (9 * a)) - math.copysign(abs(t) ** (1 / 3), t)) / math.sqrt(2 / (9 * a))
    return math.exp(-(z1 * z1 + z2 * z2) / 2)


def kolmogorov_smirnov(x) -> float:
    """p against the normal with the sample's mean and population deviation (asymptotic with a small-sample factor)."""
    x = np.sort(np.asarray(x, float))
    n, sd = len(x), x.std()
    if sd == 0:
        return 1.0
    cdf = np.array([normal_cdf(v) for v in (x - x.mean()) / sd])
    d = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    t = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def looks_normal(x, alpha: float = 0.05) -> bool:
    """Whether every available test lets normality stand."""
    tests = [shapiro(x)[1], kolmogorov_smirnov(x)] + ([dagostino(x)] if len(x) >= 8 else [])
    return all(p >= alpha for p in tests)


def paired_t(a, b) -> float:
    d = np.asarray(a, float) - np.asarray(b, float)
    sd = d.std(ddof=1)
    return float("nan") if sd == 0 and d.mean() == 0 else 0.0 if sd == 0 else t_two_sided(float(d.mean() / (sd / math.sqrt(len(d)))), len(d) - 1)


def wilcoxon(a, b) -> float:
    """Two-sided p of the signed-rank test; zero differences are left out; exact up to 25 untied ones, else normal."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return float("nan")
    size = np.abs(d)
    order = np.argsort(size)
    rank = np.empty(n)
    rank[order] = np.arange(1, n + 1)
    values, inverse, counts = np.unique(size, return_inverse=True, return_counts=True)
    rank = (np.bincount(inverse, rank) / counts)[inverse]
    t = min(rank[d > 0].sum(), rank[d < 0].sum())
    if n <= 25 and counts.max() == 1:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        return min(1.0, 2 * ways[: int(t) + 1].sum() / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return 2 * normal_cdf((t - n * (n + 1) / 4) / math.sqrt(var))


def significance(a, b, alpha: float = 0.05) -> dict:
    """The paired test of two lists of fold results: t if both look normal, else signed ranks."""
    same = list(map(float, a)) == list(map(float, b))
    normal = looks_normal(a, alpha) and looks_normal(b, alpha)
    p = float("nan") if same else paired_t(a, b) if normal else wilcoxon(a, b)
    return {"test": "paired_t" if normal else "wilcoxon", "p_value": p, "significant": bool(p < alpha), "superior": None if same else "first" if np.mean(a) > np.mean(b) else "second"}


def significance_by_metric(first: dict[str, list], second: dict[str, list], alpha: float = 0.05) -> list[dict]:
    """One row for each metric that both have."""
    return [{"metric": m} | significance(first[m], second[m], alpha) for m in first if m in second]


def popularity(urm: DataFrame, items: DataFrame) -> DataFrame:
    """One row: greatest, least and mean number of interactions of items, Gini, Shannon and Herfindahl of their shares."""
    c = items.join(urm.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").na.fill(0, ["n"])
    total = c.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    shares = c.join(F.broadcast(total)).agg(  # one row
        F.max("n").alias("most"), F.min("n").alias("least"), F.avg("n").alias("mean"), (-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("shannon"), (1 - F.sum(p * p)).alias("herfindahl")
    )
    return shares.join(gini(c, "n"))


def popularity_curve(urm: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, share of the greatest popularity, in falling order (what a popularity plot shows)."""
    c = items.join(urm.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left").na.fill(0, ["n"])
    return c.join(F.broadcast(c.agg(F.max("n").alias("m")))).select("item_id", (F.col("n") / F.col("m")).alias("share")).orderBy(F.desc("share"), "item_id")


def kendall_tau(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Tau-b of two columns from counts of equal value pairs: the self-join is over distinct pairs of values, whose
    number the greatest popularity bounds, not over items."""
    g = pairs.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").cast("double").alias("n"))
    u, v = g.select(F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1")), g.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    s = u.join(v, F.col("x1") < F.col("x2")).agg(F.sum(F.signum(F.col("y2") - F.col("y1")) * F.col("n1") * F.col("n2")).alias("s"))
    ties = lambda c: g.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(f"t{c}"), F.sum("n").alias(f"n{c}"))
    j = s.join(ties("x")).join(ties("y"))
    n0 = F.col("nx") * (F.col("nx") - 1) / 2
    return j.select((F.coalesce("s", F.lit(0.0)) / F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("tau"))

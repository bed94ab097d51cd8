"""Statistics as columns where a closed form exists, and as vectorised functions where it does not."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def rate(numerator: Column, denominator: Column) -> Column:
    """The quotient, null where the denominator is 0."""
    return F.when(denominator != 0, numerator / denominator)


def percent(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a * F.lit(100.0), b.cast("double")), F.lit(0.0))


def hwp_chisq_stat(hom1: Column, het: Column, hom2: Column) -> Column:
    """Chi-square statistic of equilibrium from genotype counts; 0 for a single allele."""
    n = (hom1 + het + hom2).cast("double")
    p = (2 * hom1 + het) / (2 * n)
    q = 1 - p
    cells = [(hom1, n * p * p), (het, 2 * n * p * q), (hom2, n * q * q)]
    terms = [F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0) for o, e in cells]
    return F.when(n > 0, terms[0] + terms[1] + terms[2]).otherwise(0.0)


@pandas_udf(DoubleType())
def chisq_sf1(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)) if v is not None and v >= 0 else float("nan"))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: series below the mean, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * scale


def chisq_sf(x: float, df: int) -> float:
    return _gamma_q(df / 2, x / 2) if df > 0 and x == x else float("nan")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _bisect(f, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def normal_ppf(p: float) -> float:
    return _bisect(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)) - p, -40.0, 40.0)


def beta_ppf(p: float, a: float, b: float) -> float:
    return _bisect(lambda x: beta_inc(a, b, x) - p, 0.0, 1.0)


def wilson_interval(x: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """Score interval of a proportion."""
    z = normal_ppf(1 - alpha / 2)
    x, n = x.cast("double"), n.cast("double")
    p = x / n
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)


def jeffreys_interval(x: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Equal-tailed interval of the beta posterior with a (1/2, 1/2) prior; the ends are closed at 0 and n."""
    low = 0.0 if x == 0 else beta_ppf(alpha / 2, x + 0.5, n - x + 0.5)
    high = 1.0 if x == n else beta_ppf(1 - alpha / 2, x + 0.5, n - x + 0.5)
    return low, high


_LOGS = [np.zeros(1)]


def log_factorials(n: int) -> np.ndarray:
    """Logarithms of 0! to n! at least; the process's table grows to the largest n asked for."""
    if len(_LOGS[0]) <= n:
        _LOGS[0] = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, max(n, 2 * len(_LOGS[0])) + 1)))))
    return _LOGS[0]


def hwp_exact(hom1: int, het: int, hom2: int) -> float:
    """Exact equilibrium probability: the total of all heterozygote counts no likelier than the one seen, by log factorials."""
    rare = 2 * min(hom1, hom2) + het
    n = hom1 + het + hom2
    if n <= 0 or rare == 0:
        return 1.0
    hets = np.arange(rare % 2, rare + 1, 2)
    homr = (rare - hets) // 2
    homc = n - hets - homr
    lg = log_factorials(n)
    logs = hets * math.log(2) - lg[hets] - lg[homr] - lg[homc]
    p = np.exp(logs - logs.max())
    p /= p.sum()
    seen = p[np.searchsorted(hets, het)]
    return float(min(1.0, p[p <= seen * (1 + 1e-9)].sum()))


@pandas_udf(DoubleType())
def hwp(hom1: pd.Series, het: pd.Series, hom2: pd.Series) -> pd.Series:
    """Exact below 8000 rare alleles, chi-square beyond."""

    def one(a, h, b):
        if 2 * min(a, b) + h < 8000:
            return hwp_exact(int(a), int(h), int(b))
        n = a + h + b
        p = (2 * a + h) / (2 * n)
        x = sum((o - e) ** 2 / e for o, e in ((a, n * p * p), (h, 2 * n * p * (1 - p)), (b, n * (1 - p) ** 2)) if e > 0)
        return math.erfc(math.sqrt(x / 2))

    return pd.Series([one(*v) for v in zip(hom1, het, hom2)], dtype="float64")


def estimate_ld(c11: np.ndarray, c12: np.ndarray, c21: np.ndarray, c22: np.ndarray, dh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """r-squared and D' from haplotype counts and double heterozygotes, by expectation-maximisation over all pairs at once."""
    c11, c12, c21, c22, dh = (np.asarray(v, float) for v in (c11, c12, c21, c22, dh))
    n = c11 + c12 + c21 + c22 + 2 * dh
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = (c11 + c12 + dh) / n, (c11 + c21 + dh) / n
        p11 = np.where(n > 0, p * q, 0.0)
        for _ in range(100):
            p12, p21 = p - p11, q - p11
            p22 = 1 - p11 - p12 - p21
            coupled = p11 * p22
            share = np.nan_to_num(coupled / (coupled + p12 * p21))
            new = (c11 + dh * share) / n
            if np.nanmax(np.abs(new - p11), initial=0) < 1e-8:
                p11 = new
                break
            p11 = new
        d = p11 - p * q
        most = np.where(d > 0, np.minimum(p * (1 - q), q * (1 - p)), np.minimum(p * q, (1 - p) * (1 - q)))
        r2 = np.nan_to_num(d * d / (p * (1 - p) * q * (1 - q)), posinf=0, neginf=0)
        dprime = np.nan_to_num(np.abs(d) / most, posinf=0, neginf=0)
    return np.clip(r2, 0, 1), np.clip(dprime, 0, 1)


def format_pvalue(p: Column, scale: int = 8) -> Column:
    small = 10.0 ** -scale
    return F.when(p.isNull() | F.isnan(p), "").when(p < small, F.format_string(f"< %.{scale}f", F.lit(small))).otherwise(F.format_string(f"%.{scale}f", p))


def permutations_needed(p: float, width: float, confidence: float) -> int:
    """Permutations after which an empirical p-value lies within a share ``width`` of the true one with the given confidence."""
    return math.ceil((1 - p) / (width * width * p) * normal_ppf((confidence + 1) / 2) ** 2)


def triangle_index(x: Column, y: Column, strict: bool = False) -> Column:
    """Place of the unordered pair (x, y) in a lower triangle read by rows; a strict one has no diagonal, so that equal places give null."""
    high, low = F.greatest(x, y).cast("bigint"), F.least(x, y).cast("bigint")
    if strict:
        return F.when(high != low, F.shiftright(high * (high - 1), 1) + low)
    return F.shiftright(high * (high + 1), 1) + low


def triangle_place(index: Column, strict: bool = False) -> Column:
    """(x, y) with x at least y of a place in a lower triangle; the inverse of :func:`triangle_index`."""
    i, shift = index.cast("bigint"), 1 if strict else 0
    guess = F.floor((F.sqrt(8 * i.cast("double") + 1) - 1) / 2).cast("bigint")
    rows_before = lambda r: F.shiftright(r * (r + 1), 1)
    # the root may be off by one at large places
    row = guess + F.when(rows_before(guess + 1) <= i, 1).when(rows_before(guess) > i, -1).otherwise(0)
    return F.struct((row + shift).cast("bigint").alias("x"), (i - rows_before(row)).alias("y"))


def scaled(x: Column, scale: float, low: int, high: int, missing: int) -> Column:
    """A number as a bounded integer, ``missing`` where it isn't finite."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.least(F.rint(x * scale), F.lit(float(high))), F.lit(float(low))).cast("int")).otherwise(missing)


def unscaled(i: Column, scale: float, missing: int) -> Column:
    return F.when(i != missing, i / F.lit(float(scale)))

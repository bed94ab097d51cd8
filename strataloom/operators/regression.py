"""Regression scans: one model for each locus, linear or logistic, with score, Wald and likelihood-ratio tests."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.functions import statistics as st

#: Codings of a dosage x of the counted allele.
CODINGS = {
    "TREND": [("trend", lambda x: x)], "DOM": [("dom", lambda x: (x > 0) * 1.0)], "REC": [("rec", lambda x: (x > 1) * 1.0)],
    "GENO": [("het", lambda x: (x == 1) * 1.0), ("hom", lambda x: (x == 2) * 1.0)], "ADOM": [("add", lambda x: x), ("het", lambda x: (x == 1) * 1.0)],
    # The reference names these two the other way round than their words say, and so do formulas written for it.
    "MISSING": [("missing", lambda x: (~np.isnan(x)) * 1.0)], "NOT_MISSING": [("not_missing", lambda x: np.isnan(x) * 1.0)], "NULL": [],
}


def parse_formula(formula: str) -> tuple[str, list[list[tuple[str, str]]], bool]:
    """``y = TERM(locus) + cov * cov2 + 0`` as (outcome, terms as products, intercept)."""
    left, _, right = formula.partition("=") if "=" in formula else formula.partition("~")
    terms, intercept = [], True
    for part in re.split(r"\+", right):
        factors = []
        for token in (t.strip() for t in part.split("*")):
            m = re.fullmatch(r"(\w+)(?:\(\s*([\w.]+)\s*\))?", token)
            if not m:
                raise ValueError(f"can't read {token!r} in {formula!r}")
            factors.append((m[1], m[2] or ""))
        if factors in ([("0", "")], [("1", "")]):
            intercept = factors[0][0] == "1"
        else:
            terms.append(factors)
    return left.strip(), terms, intercept


def design(pdf: pd.DataFrame, terms, intercept: bool) -> tuple[np.ndarray, list[str], list[bool]]:
    """The model's columns, their names, and whether each has a factor of the locus."""
    columns, names, own = ([np.ones(len(pdf))], ["intercept"], [False]) if intercept else ([], [], [])
    for factors in terms:
        product = [("", np.ones(len(pdf)))]
        for name, argument in factors:
            if argument and name.upper() in CODINGS:
                x = pdf["x" if argument == "locus" else argument].to_numpy(float)
                parts = [(label, f(x)) for label, f in CODINGS[name.upper()]]
            else:
                parts = [(name, pdf[name].to_numpy(float))]
            product = [(f"{a}:{b}" if a else b, u * v) for a, u in product for b, v in parts]
        columns += [v for _, v in product]
        names += [n for n, _ in product]
        own += [any(argument == "locus" for _, argument in factors)] * len(product)
    return np.column_stack(columns) if columns else np.empty((len(pdf), 0)), names, own


def linear(y: np.ndarray, x: np.ndarray) -> dict:
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    w = np.linalg.pinv(x.T @ x)
    rss = float(((y - x @ beta) ** 2).sum())
    n, k = x.shape
    ss = rss / max(n - k, 1)
    return {"beta": beta, "cov": ss * w, "loglike": -n / 2 * (np.log(2 * np.pi * max(rss / n, 1e-300)) + 1), "rss": rss, "df": n - k}


def logistic(y: np.ndarray, x: np.ndarray, steps: int = 50) -> dict:
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        info = x.T @ (x * (p * (1 - p))[:, None])
        move = np.linalg.pinv(info) @ (x.T @ (y - p))
        beta = beta + move
        if np.abs(move).max(initial=0) < 1e-10:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-300, 1 - 1e-16)
    info = x.T @ (x * (p * (1 - p))[:, None])
    return {"beta": beta, "cov": np.linalg.pinv(info), "loglike": float((y * np.log(p) + (1 - y) * np.log1p(-p)).sum()), "df": len(y) - x.shape[1]}


def multinomial(y: np.ndarray, x: np.ndarray, steps: int = 100) -> dict:
    """Polytomous logistic: coefficients of each category against the first."""
    kinds = np.unique(y)
    k, m = len(kinds) - 1, x.shape[1]
    hot = (y[:, None] == kinds[None, 1:]) * 1.0
    beta = np.zeros((k, m))
    for _ in range(steps):
        e = np.exp(np.clip(x @ beta.T, -30, 30))
        p = e / (1 + e.sum(1, keepdims=True))
        grad = ((hot - p).T @ x).ravel()
        info = np.zeros((k * m, k * m))
        for a in range(k):
            for b in range(k):
                wt = p[:, a] * ((a == b) - p[:, b])
                info[a * m : (a + 1) * m, b * m : (b + 1) * m] = x.T @ (x * wt[:, None])
        move = np.linalg.pinv(info) @ grad
        beta += move.reshape(k, m)
        if np.abs(move).max(initial=0) < 1e-10:
            break
    base = np.log(np.clip(1 - p.sum(1), 1e-300, None))
    ll = float(np.where(hot.sum(1) > 0, (hot * np.log(np.clip(p, 1e-300, None))).sum(1), base).sum())
    return {"beta": beta.ravel(), "cov": np.linalg.pinv(info), "loglike": ll, "df": len(y) - k * m, "categories": kinds}


def tests(y: np.ndarray, x: np.ndarray, of: list[int], fit) -> dict[str, tuple[float, int]]:
    """Statistics and degrees of freedom of leaving the columns ``of`` out."""
    full, rest = fit(y, x), [i for i in range(x.shape[1]) if i not in of]
    null = fit(y, x[:, rest])
    b, v = full["beta"][of], full["cov"][np.ix_(of, of)]
    wald = float(b @ np.linalg.pinv(v) @ b)
    lr = 2 * (full["loglike"] - null["loglike"])
    mu = x[:, rest] @ null["beta"]
    if fit is logistic:
        mu = 1 / (1 + np.exp(-np.clip(mu, -30, 30)))
        weight = mu * (1 - mu)
    else:
        weight = np.full(len(y), len(y) - len(rest)) / max(float(((y - mu) ** 2).sum()), 1e-300)
        return {"score": (float(_quadratic(x, (y - mu) * weight, weight)), len(of)), "wald": (wald, len(of)), "lr": (lr, len(of))}
    return {"score": (float(_quadratic(x, y - mu, weight)), len(of)), "wald": (wald, len(of)), "lr": (lr, len(of))}


def _quadratic(x, residual, weight):
    u = x.T @ residual
    return u @ np.linalg.pinv(x.T @ (x * weight[:, None])) @ u


def scan(data: DataFrame, formula: str, kind: str = "linear") -> DataFrame:
    """One row for each locus and model column: n, beta, se, statistic p-values of the locus's terms.

    ``data`` is long: locus, x (dosage) and the columns that the formula names. Rows with a missing value are left out. Each
    locus is one group, whose size is the number of samples.
    """
    outcome, terms, intercept = parse_formula(formula)
    fit = {"linear": linear, "logistic": logistic}[kind]
    covariates = sorted({n for t in terms for n, a in t if not a} | {a for t in terms for _, a in t if a and a != "locus"})
    schema = f"locus {dict(data.dtypes)['locus']}, term string, n long, beta double, se double, score_p double, wald_p double, lr_p double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        locus = pdf["locus"].iloc[0]
        x, names, of_locus = design(pdf, terms, intercept)
        y = pdf[outcome].to_numpy(float)
        ok = np.isfinite(y) & np.isfinite(x).all(1)
        x, y = x[ok], y[ok]
        if len(y) <= x.shape[1] or not len(names):
            return pd.DataFrame([], columns=["locus", "term", "n", "beta", "se", "score_p", "wald_p", "lr_p"])
        model = fit(y, x)
        own = [i for i, is_own in enumerate(of_locus) if is_own]
        p = {k: st.chisq_sf(max(v, 0.0), d) for k, (v, d) in tests(y, x, own, fit).items()} if own else {}
        se = np.sqrt(np.maximum(np.diag(model["cov"]), 0))
        return pd.DataFrame({"locus": locus, "term": names, "n": len(y), "beta": model["beta"], "se": se, **{f"{k}_p": p.get(k) for k in ("score", "wald", "lr")}})

    return data.select("locus", "x", outcome, *covariates).groupBy("locus").applyInPandas(run, schema)


def linear_by_locus(data: DataFrame, y: str = "y", x: str = "x") -> DataFrame:
    """Single-predictor least squares of every locus, as aggregates."""
    return data.groupBy("locus").agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")
    )


def trend(cases: list[Column], controls: list[Column]) -> Column:
    """Cochran-Armitage trend statistic of a 2 x c table with scores 0, 1, ..."""
    a, n = sum(cases[1:], cases[0]), sum(cases[1:], cases[0]) + sum(controls[1:], controls[0])
    cols = [x + y for x, y in zip(cases, controls)]
    t = sum((F.lit(i) * (x * n - c * a) for i, (x, c) in enumerate(zip(cases, cols))), F.lit(0.0))
    s1 = sum((F.lit(i) * c for i, c in enumerate(cols)), F.lit(0.0))
    s2 = sum((F.lit(i * i) * c for i, c in enumerate(cols)), F.lit(0.0))
    return F.coalesce(F.try_divide(n * t * t, a * (n - a) * (n * s2 - s1 * s1)), F.lit(0.0))


def contingency(df: DataFrame, a: str, b: str, min_margin: int = 0) -> DataFrame:
    """Pearson statistic and degrees of freedom of two columns, without sparse rows and columns."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    for side in "ab":
        good = cells.groupBy(side).agg(F.sum("o").alias("m")).where(F.col("m") >= min_margin).select(side)
        cells = cells.join(good, side, "left_semi")
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cells.agg(F.sum("o").alias("t"))
    # sum of o^2/e over filled cells, less the total, equals the sum over all cells
    filled = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))
    stat = F.sum(F.col("o") * F.col("o") * F.col("t") / (F.col("ra") * F.col("cb").cast("double"))) - F.first("t")
    return filled.agg(stat.alias("chisq"), ((F.count_distinct("a") - 1) * (F.count_distinct("b") - 1)).alias("df"))

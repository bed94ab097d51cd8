"""Least squares by group from added-up products, penalised regression paths, summaries of a variable, and shares of ancestry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType

from strataloom.plans.workspace import Workspace


@F.pandas_udf(ArrayType(DoubleType()))
def _solved(products: pd.Series, targets: pd.Series) -> pd.Series:
    out = []
    for xx, xy in zip(products, targets):
        k = len(xy)
        out.append(np.linalg.lstsq(np.array([list(r) for r in xx], float).reshape(k, k), np.array(xy, float), rcond=1e-12)[0].tolist())
    return pd.Series(out)


def correct_by_terms(df: DataFrame, by: str, value: str, terms: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """``df`` with ``corrected``: the value without what the group's least squares on the terms explains; each group keeps its mean.

    A group's fit takes its rows with a finite value between ``low`` and ``high`` and finite terms. Its centred products are added up in one aggregate, combined
    before the shuffle, so a group of any size is one small row when it is solved. Terms that say nothing get 0. Where a term is missing so is the result.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf"))
    used = finite(value)
    for t in terms:
        used = used & finite(t)
    used = used & (F.lit(True) if low is None else F.col(value) >= low) & (F.lit(True) if high is None else F.col(value) <= high)
    good = df.where(used)
    cov = lambda a, b: F.coalesce(F.covar_pop(a, b), F.lit(0.0))
    fits = good.groupBy(by).agg(
        F.array(*[F.array(*[cov(a, b) for b in terms]) for a in terms]).alias("__xx"), F.array(*[cov(a, value) for a in terms]).alias("__xy"), F.array(*[F.avg(t) for t in terms]).alias("__means"),
    )
    fits = fits.select(by, _solved("__xx", "__xy").alias("__beta"), "__means")
    joined = df.join(fits, by, "left")
    moved = sum(((F.col(t) - F.get("__means", k)) * F.get("__beta", k) for k, t in enumerate(terms)), F.lit(0.0))
    return joined.withColumn("corrected", F.when(F.col("__beta").isNull(), F.col(value)).otherwise(F.col(value) - moved)).drop("__beta", "__means")


def elastic_net(df: DataFrame, target: str, terms: list[str], penalties: list[float], mix: float = 1.0, standardize: bool = True) -> DataFrame:
    """(penalty, term, beta) along a path of penalties, the intercept as a term of its own; ``mix`` 1 is the lasso and 0 ridge.

    Rows with a missing value are left out. Each penalty is a fit of its own, distributed over the rows.
    """
    spark = df.sparkSession
    ready = VectorAssembler(inputCols=terms, outputCol="__x").transform(df.select(F.col(target).cast("double").alias("__y"), *terms).dropna()).select("__y", "__x")
    out = []
    for penalty in penalties:
        fit = LinearRegression(featuresCol="__x", labelCol="__y", regParam=float(penalty), elasticNetParam=float(mix), standardization=standardize, solver="auto", tol=1e-9, maxIter=1000).fit(ready)
        out += [(float(penalty), "intercept", float(fit.intercept)), *((float(penalty), t, float(b)) for t, b in zip(terms, fit.coefficients))]
    return spark.createDataFrame(out, "penalty double, term string, beta double")


def variable_summary(df: DataFrame, value: str, categories: int = 5) -> DataFrame:
    """One row on a variable: its kind (constant, binary, categorical up to ``categories`` values, continuous), extent, mean, median and standard deviation. Nulls don't count."""
    v = F.col(value).cast("double")
    out = df.where(F.col(value).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(v).alias("distinct"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("max"), F.stddev_pop(v).alias("sd"))
    kind = F.when(F.col("distinct") == 0, "empty").when(F.col("distinct") == 1, "constant").when(F.col("distinct") == 2, "binary").when(F.col("distinct") <= categories, "categorical").otherwise("continuous")
    return out.select(kind.alias("kind"), "*")


# --- ancestry ----------------------------------------------------------------------------


def population_frequencies(dosages: DataFrame, populations: DataFrame, model: str = "HWP") -> DataFrame:
    """(locus, population, x, f): frequency of each dosage in each population of (sample, population).

    ``HWP``: from the allele frequency; ``GENO``: from the genotypes themselves, each taken as seen once at least.
    """
    counts = dosages.where("x IS NOT NULL").join(populations, "sample").groupBy("locus", "population").agg(*[F.count_if(F.col("x") == k).cast("double").alias(f"n{k}") for k in range(3)])
    n = [F.col(f"n{k}") for k in range(3)]
    if model == "HWP":
        q = (n[1] + 2 * n[2]) / (2 * (n[0] + n[1] + n[2]))
        f = [(1 - q) * (1 - q), 2 * q * (1 - q), q * q]
    elif model == "GENO":
        n = [F.greatest(c, F.lit(1.0)) for c in n]
        f = [c / (n[0] + n[1] + n[2]) for c in n]
    else:
        raise ValueError(f"no frequency model named {model!r}")
    return counts.select("locus", "population", F.posexplode(F.array(*f)).alias("x", "f"))


def mixing_shares(f: np.ndarray, steps: int = 20_000, tolerance: float = 1e-12) -> tuple[np.ndarray, float]:
    """Shares of k sources that make n events likeliest, from their frequencies (n, k), and the log-likelihood; by expectation-maximisation from equal shares."""
    shares, loglik = many_mixing_shares([f], steps, tolerance)
    return shares[0], float(loglik[0])


def many_mixing_shares(groups: list[np.ndarray], steps: int = 20_000, tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """:func:`mixing_shares` of many groups in one go: shares (groups, k) and log-likelihoods. A group that has come to its end isn't moved again."""
    size = np.array([len(f) for f in groups])
    k = groups[0].shape[1]
    full = np.zeros((k, size.max(), len(groups)))
    inside = np.arange(size.max())[:, None] < size
    for j, f in enumerate(groups):
        full[:, : len(f), j] = f.T
    full[:, ~inside] = 1.0
    shares = np.full((k, len(groups)), 1 / k)
    left = np.arange(len(groups))
    f, weight, x = full, inside / size, shares.copy()
    for _ in range(steps):
        likely = weight / sum(x[i] * f[i] for i in range(k))
        new = np.stack([x[i] * np.einsum("ij,ij->j", f[i], likely) for i in range(k)])
        moving = np.abs(new - x).max(axis=0) >= tolerance
        x = new
        if not moving.all():
            shares[:, left] = x
            left, f, weight, x = left[moving], f[:, :, moving], weight[:, moving], x[:, moving]
            if not len(left):
                break
    shares[:, left] = x
    mixed = np.where(inside, sum(shares[i] * full[i] for i in range(k)), 1.0)
    return shares.T, np.log(mixed).sum(axis=0)


#: Values of a batch of samples whose shares are estimated together.
_BATCH = 1 << 16


def admixture(dosages: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(sample, population, share, loglik) of each sample's genotypes at loci where all populations have a frequency.

    Genotypes that no population has say nothing and are left out. A sample's loci are one group: its size is populations times loci.
    """
    frequencies = Workspace(frequencies.sparkSession, "admixture").table(frequencies, "frequencies")
    names = [r[0] for r in frequencies.select("population").distinct().orderBy("population").collect()]
    wide = frequencies.groupBy("locus", "x").agg(F.map_from_entries(F.collect_list(F.struct("population", "f"))).alias("m")).where(F.size("m") == len(names))
    wide = wide.select("locus", "x", F.array(*[F.try_element_at("m", F.lit(p)) for p in names]).alias("f")).where(F.exists("f", lambda v: v > 0))
    events = dosages.where("x IS NOT NULL").join(wide, ["locus", "x"])
    by_sample = events.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("locus", "f"))).alias("e"))
    ready = by_sample.select("sample", F.flatten(F.col("e.f")).alias("f"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            length = pc.list_value_length(whole["f"]).to_numpy()
            order = np.argsort(length, kind="stable")  # samples of like size go together: less is filled up
            begin = 0
            while begin < len(order):
                end = begin + 1
                while end < len(order) and length[order[end]] * (end + 1 - begin) <= _BATCH:
                    end += 1
                batch = whole.take(pa.array(order[begin:end]))
                begin = end
                shares, loglik = many_mixing_shares([np.array(f).reshape(-1, len(names)) for f in batch["f"].to_pylist()])
                each = np.repeat(np.arange(len(batch)), len(names))
                yield pa.RecordBatch.from_arrays([batch["sample"].take(pa.array(each)), pa.array(names * len(batch)).cast(population), pa.array(shares.ravel()), pa.array(loglik[each])], ["sample", "population", "share", "loglik"])

    kinds = [df.schema[c].dataType for df, c in ((dosages, "sample"), (frequencies, "population"))]
    population = to_arrow_type(kinds[1])
    return ready.mapInArrow(fit, f"sample {kinds[0].simpleString()}, population {kinds[1].simpleString()}, share double, loglik double")

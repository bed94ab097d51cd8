"""Array intensities: power transforms, quantile normalisation, trimmed means, cluster centres, and log ratios with allele shares."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.plans.workspace import Workspace


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def boxcox(x: Column, power: float = 0.0, shift: float = 0.0, base: float | None = None) -> Column:
    """Shifted Box-Cox transform; the logarithm where ``power`` is 0. Null where it is undefined."""
    if power < 0:
        raise ValueError("the power must not be negative")
    y = x.cast("double") - shift
    out = F.ln(y) if power == 0 else F.when(y >= 0, (F.pow(y, F.lit(power)) - 1) / power)
    return out if base is None else out / math.log(base)


def modulus(x: Column, power: float = 0.0, base: float | None = None) -> Column:
    """Modulus transform: odd in ``x``, so that it takes negative values too."""
    if power < 0:
        raise ValueError("the power must not be negative")
    size = F.abs(x.cast("double")) + 1
    out = F.signum(x) * (F.ln(size) if power == 0 else (F.pow(size, F.lit(power)) - 1) / power)
    return out if base is None else out / math.log(base)


def quantile_normalize(df: DataFrame, by: str, x: str, y: str, least: float | None = None, most: float | None = None) -> DataFrame:
    """Both channels of a group get the mean of their values of equal rank, within ``least`` and ``most`` times their own.

    Ranks run over rows where both are finite; the others stay. Ranks come from one sort a channel and group, so a group is
    one array's probes; rows of equal value keep their mean's order by the other channel.
    """
    ok = _finite(F.col(x)) & _finite(F.col(y))
    key = "__row"
    numbered = df.withColumn(key, F.monotonically_increasing_id())
    good = numbered.where(ok)
    rank = lambda a, b: F.row_number().over(Window.partitionBy(by).orderBy(a, b, key))
    ranked = good.withColumns({"__rx": rank(x, y), "__ry": rank(y, x)})
    levels = ranked.select(by, F.col("__rx").alias("__r"), F.col(x).alias("__u")).join(ranked.select(by, F.col("__ry").alias("__r"), F.col(y).alias("__v")), [by, "__r"])
    levels = levels.select(by, "__r", ((F.col("__u") + F.col("__v")) / 2).alias("__level"))
    bound = lambda v, own: F.least(F.greatest(v, own * least) if least is not None else v, own * most) if most is not None else (F.greatest(v, own * least) if least is not None else v)
    out = ranked.join(levels.toDF(by, "__rx", "__lx"), [by, "__rx"]).join(levels.toDF(by, "__ry", "__ly"), [by, "__ry"])
    changed = out.withColumns({x: bound(F.col("__lx"), F.col(x)), y: bound(F.col("__ly"), F.col(y))}).select(*df.columns)
    return changed.unionByName(numbered.where(~ok).select(*df.columns))


def trimmed_mean(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, mean) of each group's finite values without the least and greatest ``share`` of them.

    Equal values are one row with their number; ranges of (group, value) are looked at apart, each after the numbers of the ranges before.
    """
    counts = df.where(_finite(F.col(value))).groupBy(by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ranges = counts.repartitionByRange(by, "__v").withColumn("__range", F.spark_partition_id())
    ranges = Workspace(df.sparkSession, "trimmed").table(ranges, "ranges")
    own = Window.partitionBy("__g").orderBy("__range")
    sizes = ranges.groupBy(F.col(by).alias("__g"), F.col("__range").alias("__at")).agg(F.sum("__c").alias("__size")).withColumnRenamed("__at", "__range")
    before = F.coalesce(F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"__before": before, "__n": F.sum("__size").over(Window.partitionBy("__g"))}).withColumnRenamed("__range", "__at")
    placed = ranges.join(sizes, (F.col("__range") == F.col("__at")) & F.col(by).eqNullSafe(F.col("__g")))
    last = F.col("__before") + F.sum("__c").over(Window.partitionBy("__range", by).orderBy("__v"))
    cut = F.floor(F.col("__n") * F.lit(float(share)))
    kept = F.least(F.col("__last"), F.col("__n") - cut) - F.greatest(F.col("__last") - F.col("__c"), cut)
    kept = placed.withColumn("__last", last).withColumn("__kept", kept).where("__kept > 0")
    return kept.groupBy(by).agg((F.sum(F.col("__v").cast("double") * F.col("__kept")) / F.sum("__kept")).alias("mean"))


def cluster_centres(df: DataFrame) -> DataFrame:
    """(locus, t_aa, r_aa, t_ab, r_ab, t_bb, r_bb) from rows (locus, g, r, theta) with g one of AA, AB, BB; one aggregate, combined before its shuffle.

    Where no heterozygote is seen its centre lies halfway between the homozygotes.
    """
    mean = lambda c, g: F.avg(F.when(F.col("g") == g, F.col(c)))
    seen = df.where(_finite(F.col("r")) & _finite(F.col("theta"))).groupBy("locus").agg(
        *[mean(c, g).alias(f"{n}_{g.lower()}") for g in ("AA", "AB", "BB") for c, n in (("theta", "t"), ("r", "r"))])
    half = lambda n: F.coalesce(F.col(f"{n}_ab"), (F.col(f"{n}_aa") + F.col(f"{n}_bb")) / 2)
    return seen.withColumns({"t_ab": half("t"), "r_ab": half("r")})


def log_ratio(r: Column, theta: Column, centres: dict[str, Column]) -> tuple[Column, Column]:
    """(log2 of observed to expected intensity, share of the B allele) by interpolation between the centres of :func:`cluster_centres`."""
    c = centres
    low = F.try_divide(theta - c["t_aa"], c["t_ab"] - c["t_aa"])
    high = F.try_divide(theta - c["t_ab"], c["t_bb"] - c["t_ab"])
    expected = (
        F.when(theta <= c["t_aa"], c["r_aa"]).when(theta <= c["t_ab"], c["r_aa"] + (c["r_ab"] - c["r_aa"]) * low)
        .when(theta < c["t_bb"], c["r_ab"] + (c["r_bb"] - c["r_ab"]) * high).when(theta >= c["t_bb"], c["r_bb"])
    )
    share = F.when(theta <= c["t_aa"], 0.0).when(theta <= c["t_ab"], low / 2).when(theta < c["t_bb"], (high + 1) / 2).when(theta >= c["t_bb"], 1.0)
    return F.log2(r / (expected + 1e-6)), share


def baf_deviation(share: Column) -> Column:
    """Distance of an allele share from the nearest of 0, a half and 1."""
    return F.least(F.abs(share), F.abs(share - 0.5), F.abs(share - 1.0))

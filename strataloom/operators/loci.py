"""Loci as tables (locus, chrom, location, ...): filters, neighbourhoods of monitored loci, LD matrices, and two genotype sets compared locus by locus."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructType

from strataloom.functions import statistics as st
from strataloom.operators import genotypes as g

#: Complements of the bases.
PAIRED = {"A": "T", "C": "G", "G": "C", "T": "A"}


# --- filters -----------------------------------------------------------------------------


def by_maf(loci: DataFrame, least: float, obligate: DataFrame | None = None, least_obligate: float = 0.0) -> DataFrame:
    """Loci (locus, maf) with a frequency of ``least`` or more; those of the one-column table ``obligate`` have a threshold of their own."""
    if obligate is None:
        return loci.where(F.col("maf") >= least)
    named = obligate.select(F.col(f"`{obligate.columns[0]}`").alias("locus"), F.lit(True).alias("__named")).distinct()
    threshold = F.when(F.col("__named"), least_obligate).otherwise(least)
    return loci.join(named, "locus", "left").where(F.col("maf") >= threshold).select(*loci.columns)


def by_hwp(genotypes: DataFrame, least: float) -> DataFrame:
    """(locus, hwp) of loci whose equilibrium probability is ``least`` or more."""
    counts = g.biallelic(genotypes)
    return counts.select("locus", st.hwp("hom1", "het", "hom2").alias("hwp")).where(F.col("hwp") >= least)


def ranges(text: str) -> list[tuple[int | None, int | None]]:
    """Half-open ranges of ``10-20,50-``: an open end is None, and ends in the wrong order are put right."""
    out = []
    for part in text.split(","):
        ends = part.split("-")
        if len(ends) != 2:
            raise ValueError(f"no range: {part!r}")
        low, high = (int(e) if e.strip() else None for e in ends)
        out.append((high, low) if low is not None and high is not None and high < low else (low, high))
    return out


def by_range(loci: DataFrame, text: str) -> DataFrame:
    """Loci whose location is in one of the ranges; a plain predicate, so that it reaches the scan."""
    keep, at = F.lit(False), F.col("location")
    for low, high in ranges(text):
        inside = F.lit(True) if low is None else at >= low
        keep = keep | (inside if high is None else inside & (at < high))
    return loci.where(keep)


def by_completion(genotypes: DataFrame, least: int = 0, least_rate: float = 0.0) -> DataFrame:
    """(locus, called, total, completion) of loci with enough called genotypes and a large enough share of them."""
    return g.completion(genotypes, "locus").where((F.col("called") >= least) & (F.col("completion") >= least_rate))


def near_monitored(loci: DataFrame, monitored: DataFrame, max_distance: int) -> DataFrame:
    """Loci within ``max_distance`` of a locus that is named in the one-column table ``monitored``.

    Monitored places stand in their own bin and both neighbours; they are made distinct by bin and place before the semi-join.
    """
    width = max(1, max_distance)
    named = monitored.select(F.col(f"`{monitored.columns[0]}`").alias("locus")).distinct()
    bin_of = F.floor(F.col("location") / width)
    places = loci.join(named, "locus", "left_semi").select("chrom", F.col("location").alias("__at"), bin_of.alias("__b"))
    places = places.distinct().select("chrom", "__at", F.explode(F.sequence(F.col("__b") - 1, F.col("__b") + 1)).alias("__bin"))
    near = F.abs(F.col("l.location") - F.col("m.__at")) <= max_distance
    left = loci.withColumn("__bin", bin_of).alias("l")
    joined = left.join(places.alias("m"), (F.col("l.chrom") == F.col("m.chrom")) & (F.col("l.__bin") == F.col("m.__bin")) & near, "left_semi")
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in loci.columns])


# --- LD ----------------------------------------------------------------------------------


def ld_matrix(pairs: DataFrame, measure: str = "r2", columns: list | None = None) -> DataFrame:
    """Wide form of pairs (locus1, locus2, measure), blank where a pair is absent. Meant for a region: a column for each second locus."""
    return pairs.groupBy("locus1").pivot("locus2", columns).agg(F.first(measure))


# --- two sets ----------------------------------------------------------------------------


def trend_r2(x: str, y: str) -> Column:
    """Aggregate: squared correlation of two codings over rows where both are known; 0 where it is undefined."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c).cast("double")) for c in (x, y))
    n, sa, sb = F.count_if(both), F.sum(a), F.sum(b)
    cov, va, vb = n * F.sum(a * b) - sa * sb, n * F.sum(a * a) - sa * sa, n * F.sum(b * b) - sb * sb
    return F.when((va > 0) & (vb > 0), cov * cov / (va * vb)).otherwise(0.0)


def _paired(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Cells of loci that both sets have; a sample that one of them lacks is missing there."""
    shared = left.select("locus").distinct().join(right.select("locus").distinct(), "locus", "left_semi")
    side = lambda df, k: df.select("sample", "locus", *[F.col(c).alias(f"{c}_{k}") for c in columns])
    return side(left, 1).join(side(right, 2), ["sample", "locus"], "full").join(shared, "locus", "left_semi")


def genotype_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sets (sample, locus, a1, a2) with one row a cell, compared by locus: missing shares, frequencies, concordance, comparisons and trend r-squared.

    Frequencies and codings count each set's own greatest allele there. Without comparisons concordance is 1.
    """
    cells = _paired(left, right, ["a1", "a2"])
    last = cells.groupBy("locus").agg(*[F.max(F.greatest(f"a1_{k}", f"a2_{k}")).alias(f"__b{k}") for k in (1, 2)])
    called = lambda k: F.col(f"a1_{k}").isNotNull() & F.col(f"a2_{k}").isNotNull()
    copies = lambda k: F.when(called(k), sum((F.col(f"{a}_{k}") == F.col(f"__b{k}")).cast("int") for a in ("a1", "a2")))
    coded = cells.join(last, "locus").withColumns({"__x": copies(1), "__y": copies(2)})
    both = called(1) & called(2)
    same = both & (F.col("a1_1") == F.col("a1_2")) & (F.col("a2_1") == F.col("a2_2"))
    freq = lambda x: F.coalesce(F.avg(x) / 2, F.lit(0.0))
    out = coded.groupBy("locus").agg(
        F.count(F.lit(1)).alias("samples"), F.avg((~called(1)).cast("double")).alias("missing1"), freq("__x").alias("__f1"), F.avg((~called(2)).cast("double")).alias("missing2"),
        freq("__y").alias("__f2"), F.count_if(same).alias("__same"), F.count_if(both).alias("comps"), trend_r2("__x", "__y").alias("r2_trend"),
    )
    minor = lambda c: F.least(F.col(c), 1 - F.col(c))
    concordance = F.when(F.col("comps") > 0, F.col("__same") / F.col("comps")).otherwise(1.0)
    return out.select("locus", "samples", "missing1", minor("__f1").alias("maf1"), "missing2", minor("__f2").alias("maf2"), concordance.alias("concordance"), "comps", "r2_trend")


def dosage_correlation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two sets of dosages (sample, locus, x) from 0 to 1, compared by locus: missing shares, frequencies and squared correlation."""
    cells = _paired(left, right, ["x"])
    freq = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = cells.groupBy("locus").agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.col("x_1").isNull().cast("double")).alias("missing1"), freq("x_1").alias("__f1"),
        F.avg(F.col("x_2").isNull().cast("double")).alias("missing2"), freq("x_2").alias("__f2"), trend_r2("x_1", "x_2").alias("r2"),
    )
    minor = lambda c: F.least(F.col(c), 1 - F.col(c))
    return out.select("locus", "samples", "missing1", minor("__f1").alias("maf1"), "missing2", minor("__f2").alias("maf2"), "r2")


# --- allele maps -------------------------------------------------------------------------

_MAPPED = StructType().add("concord", LongType()).add("ident", LongType()).add("allele_map", MapType(StringType(), StringType()))


def _best_map(cells: list) -> tuple[int, int, dict]:
    left = sorted({a for c in cells for a in (c["a1_1"], c["a2_1"])})
    right = sorted({a for c in cells for a in (c["a1_2"], c["a2_2"])})
    # a map is one-to-one; where one side has more alleles, the rest of it stays unmapped
    if len(left) >= len(right):
        maps = (dict(zip(right, chosen)) for chosen in itertools.permutations(left, len(right)))
    else:
        maps = (dict(zip(chosen, left)) for chosen in itertools.permutations(right, len(left)))
    best = None
    for m in maps:
        agree = sum(c["n"] for c in cells if sorted((m.get(c["a1_2"], ""), m.get(c["a2_2"], ""))) == sorted((c["a1_1"], c["a2_1"])))
        rank = (agree, sum(a == b for a, b in m.items()))
        if best is None or rank > best[0]:
            best = (rank, m)
    return best[0][0], best[0][1], best[1]


@F.pandas_udf(_MAPPED)
def _mapped(cells: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_best_map(list(c)) for c in cells], columns=["concord", "ident", "allele_map"])


def remap_category(allele_map: Column) -> Column:
    """What a map (right allele to left allele) does: identity, complement, swap, parts of these, or other."""
    pairs = F.map_entries(allele_map)
    table = F.create_map(*[F.lit(x) for k, v in PAIRED.items() for x in (k, v)])
    n, count = F.size(pairs), lambda test: F.size(F.filter(pairs, lambda e: F.coalesce(test(e["key"], e["value"]), F.lit(False))))
    same = count(lambda a, b: a == b)
    paired = count(lambda a, b: F.try_element_at(table, b) == a)
    swapped = count(lambda a, b: F.try_element_at(allele_map, b) == a)
    return (
        F.when(same == n, "identity").when(paired == n, "complement").when((same == 0) & (swapped == n), "swap").when(paired + same == n, "partial complement")
        .when(swapped + same > n, "partial swap").otherwise("other")
    )


def remap_alleles(left: DataFrame, right: DataFrame) -> DataFrame:
    """(locus, concord, ident, allele_map, category): the one-to-one map of the right set's alleles with the most concordant cells, of ties the one that keeps most alleles.

    Cells are counted by genotype pair before the few alleles of a locus are permuted, so a group is bounded by the allele count and not by samples.
    """
    pair = ["a1_1", "a2_1", "a1_2", "a2_2"]
    cells = _paired(left, right, ["a1", "a2"]).dropna(subset=pair).groupBy("locus", *pair).agg(F.count(F.lit(1)).alias("n"))
    found = cells.groupBy("locus").agg(F.collect_list(F.struct(*pair, "n")).alias("c")).select("locus", _mapped("c").alias("m"))
    return found.select("locus", "m.concord", "m.ident", "m.allele_map", remap_category(F.col("m.allele_map")).alias("category"))

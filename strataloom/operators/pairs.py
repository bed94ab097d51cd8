"""Locus pairs within a distance: linkage disequilibrium, surrogates, tags, and components of pairs."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from strataloom.functions.statistics import estimate_ld
from strataloom.plans.workspace import Workspace


def band_pairs(loci: DataFrame, max_distance: int, max_value: str = "location") -> DataFrame:
    """Ordered pairs (locus1, locus2) of one chromosome with 0 < distance <= max_distance.

    Each locus stands in its own bin and the next one, each partner in its own: pairs join on equal bins.
    """
    width = max(1, max_distance)
    own = loci.select("chrom", F.col("locus").alias("locus2"), F.col(max_value).alias("loc2"), F.floor(F.col(max_value) / width).alias("bin"))
    reach = loci.select("chrom", F.col("locus").alias("locus1"), F.col(max_value).alias("loc1"), F.floor(F.col(max_value) / width).alias("b"))
    reach = reach.withColumn("bin", F.explode(F.array("b", F.col("b") + 1))).drop("b")
    later = (F.col("loc2") > F.col("loc1")) | ((F.col("loc2") == F.col("loc1")) & (F.col("locus2") > F.col("locus1")))
    return reach.join(own, ["chrom", "bin"]).where(later & (F.col("loc2") - F.col("loc1") <= max_distance)).drop("bin")


def packed(dosages: DataFrame) -> DataFrame:
    """(locus, word, m0, m1, m2): for each run of 64 samples, in the order of names, bits of those with 0, 1 and 2 copies. A cell has one row."""
    known = dosages.where("x IN (0, 1, 2)")
    place = known.select("sample").distinct().withColumn("place", F.row_number().over(Window.orderBy("sample")) - 1)  # one row a sample
    bit = F.expr("shiftleft(1L, place % 64)")
    masks = [F.coalesce(F.bit_or(F.when(F.col("x") == k, bit)), F.lit(0).cast("bigint")).alias(f"m{k}") for k in range(3)]
    return known.join(place, "sample").groupBy("locus", F.floor(F.col("place") / 64).alias("word")).agg(*masks)


def haplotype_counts(dosages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(locus1, locus2, c11, c12, c21, c22, dh) from dosages (sample, locus, x) of pairs: nine counts of common bits.

    A pair meets in one row for 64 samples, so joins move a row a word and not one a sample.
    """
    words = packed(dosages)
    side = lambda name, m: words.select(F.col("locus").alias(name), "word", *[F.col(f"m{k}").alias(f"{m}{k}") for k in range(3)])
    both = pairs.select("locus1", "locus2").join(side("locus1", "p"), "locus1").join(side("locus2", "q"), ["locus2", "word"])
    common = lambda x, y: F.sum(F.bit_count(F.col(f"p{x}").bitwiseAND(F.col(f"q{y}")))).cast("bigint").alias(f"n{x}{y}")
    counts = both.groupBy("locus1", "locus2").agg(*[common(x, y) for x in range(3) for y in range(3)])
    n = lambda x, y: F.col(f"n{x}{y}")
    counts = counts.where(sum(n(x, y) for x in range(3) for y in range(3)) > 0)  # a common word need not have a common sample
    return counts.select(
        "locus1", "locus2", (2 * n(0, 0) + n(0, 1) + n(1, 0)).alias("c11"), (2 * n(0, 2) + n(0, 1) + n(1, 2)).alias("c12"),
        (2 * n(2, 0) + n(2, 1) + n(1, 0)).alias("c21"), (2 * n(2, 2) + n(2, 1) + n(1, 2)).alias("c22"), n(1, 1).alias("dh"),
    )


@F.pandas_udf(StructType().add("r2", DoubleType()).add("dprime", DoubleType()))
def _ld(c11: pd.Series, c12: pd.Series, c21: pd.Series, c22: pd.Series, dh: pd.Series) -> pd.DataFrame:
    r2, dprime = estimate_ld(*(v.to_numpy() for v in (c11, c12, c21, c22, dh)))
    return pd.DataFrame({"r2": r2, "dprime": dprime})


def ld_pairs(dosages: DataFrame, pairs: DataFrame, r2: float = 0.0, dprime: float = 0.0) -> DataFrame:
    """LD of pairs from estimated haplotype frequencies."""
    counts = haplotype_counts(dosages, pairs).withColumn("ld", _ld("c11", "c12", "c21", "c22", "dh"))
    return counts.select("locus1", "locus2", "ld.r2", "ld.dprime").where((F.col("r2") >= r2) & (F.col("dprime") >= dprime))


def bound_r2(c11, c12, c21, c22, dh):
    """Upper bound of r-squared from the margins."""
    n = c11 + c12 + c21 + c22 + 2 * dh
    p, q = (c11 + c12 + dh) / n, (c11 + c21 + dh) / n
    most = F.greatest(F.least(p * (1 - q), q * (1 - p)), F.least(p * q, (1 - p) * (1 - q)))
    return F.coalesce(F.try_divide(most * most, p * (1 - p) * q * (1 - q)), F.lit(0.0))


def dosage_r2(dosages: DataFrame, pairs: DataFrame) -> DataFrame:
    """Squared correlation of dosages; 0 where undefined."""
    d = dosages.where("x IS NOT NULL")
    a = d.select("sample", F.col("locus").alias("locus1"), F.col("x").alias("x"))
    b = d.select("sample", F.col("locus").alias("locus2"), F.col("x").alias("y"))
    r = F.corr("x", "y")
    both = pairs.select("locus1", "locus2").join(a, "locus1").join(b, ["locus2", "sample"])
    return both.groupBy("locus1", "locus2").agg(F.coalesce(F.nanvl(r * r, F.lit(0.0)), F.lit(0.0)).alias("r2"), F.count(F.lit(1)).alias("n"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("locus1", "locus2", "r2").unionByName(pairs.select(F.col("locus2").alias("locus1"), F.col("locus1").alias("locus2"), "r2"))


def surrogates(pairs: DataFrame, k: int = 3, needles: DataFrame | None = None, panel: DataFrame | None = None) -> DataFrame:
    """The k best partners of each locus by r2; ties go to the panel's loci, then to the later name."""
    both = both_ways(pairs).toDF("needle", "surrogate", "r2")
    if needles is not None:
        both = both.join(needles.toDF("needle"), "needle", "left_semi")
    both = both.withColumn("prio", F.lit(0)) if panel is None else both.join(panel.toDF("surrogate").withColumn("prio", F.lit(1)), "surrogate", "left").fillna(0, ["prio"])
    w = Window.partitionBy("needle").orderBy(F.desc("r2"), F.desc("prio"), F.desc("surrogate"))
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("needle", "surrogate", "r2", "rank")


def best_tag(pairs: DataFrame, tags: DataFrame) -> DataFrame:
    """For each locus the tag with the largest r2; ties go to the first name."""
    tagged = both_ways(pairs).join(tags.toDF("locus2"), "locus2", "left_semi")
    best = tagged.groupBy("locus1").agg(F.min(F.struct((-F.col("r2")).alias("r"), "locus2")).alias("b"))
    return best.select(F.col("locus1").alias("locus"), F.col("b.locus2").alias("tag"), (-F.col("b.r")).alias("r2"))


def regions(loci: DataFrame, max_distance: int) -> DataFrame:
    """Region number of each locus: a gap of more than max_distance begins a new one."""
    w = Window.partitionBy("chrom").orderBy("location", "locus")
    gap = F.when(F.col("location") - F.lag("location").over(w) > max_distance, 1).otherwise(0)
    return loci.withColumn("gap", gap).withColumn("region", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")


def _greedy(members: dict, maf: dict) -> list[tuple]:
    """Repeatedly take the largest bin (then highest frequency, then first name) and all its members."""
    left = {k: set(v) | {k} for k, v in members.items()}
    heap = [(-len(v), -maf.get(k, 0.0), k) for k, v in left.items()]
    heapq.heapify(heap)
    gone, out, number = set(), [], 0
    while heap:
        size, freq, k = heapq.heappop(heap)
        if k in gone:
            continue
        now = left[k] - gone
        if -size != len(now):  # its bin has shrunk since
            heapq.heappush(heap, (-len(now), freq, k))
            continue
        number += 1
        out += [(k, m, number, len(now)) for m in sorted(now)]
        gone |= now
    return out


def greedy_tags(loci: DataFrame, pairs: DataFrame, max_distance: int, r2: float = 0.8) -> DataFrame:
    """Greedy bins of each region: (chrom, region, tag, locus, bin, size). Regions are independent, so one task takes one region.

    ``loci`` has (chrom, location, locus, maf).
    """
    placed = regions(loci, max_distance)
    near = both_ways(pairs).where(F.col("r2") >= r2).select(F.col("locus1").alias("locus"), F.col("locus2").alias("other"))
    sets = placed.join(near, "locus", "left").groupBy("chrom", "region", "locus").agg(F.max("maf").alias("maf"), F.collect_set("other").alias("others"))
    kind = dict(loci.dtypes)["locus"]

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        members = dict(zip(pdf["locus"], pdf["others"]))
        found = _greedy(members, dict(zip(pdf["locus"], pdf["maf"].fillna(0.0))))
        out = pd.DataFrame(found, columns=["tag", "locus", "bin", "size"])
        out.insert(0, "region", pdf["region"].iloc[0])
        out.insert(0, "chrom", pdf["chrom"].iloc[0])
        return out

    return sets.groupBy("chrom", "region").applyInPandas(bins, f"chrom {dict(loci.dtypes)['chrom']}, region long, tag {kind}, locus {kind}, bin long, size long")


def rank_tags(bins: DataFrame, pairs: DataFrame, scores: DataFrame | None = None, criteria: dict[str, float] | None = None, required: int = 1) -> DataFrame:
    """(bin, tag, score, rank, recommended) of bins' members (bin, locus, tag) by design score and by what they say about the others.

    A criterion's penalty divides the score of every tag that isn't the best by it in its bin: maxsnp (least r2 with any member), avgsnp (sum of r2), maxtag and avgtag (the same over members that are
    no tags). Scores (locus, score) are 0 where missing, 1 for all if there is no table; ties go to the later name. The first ``required`` tags are recommended.
    """
    members = bins.select("bin", "locus", F.col("tag").cast("boolean").alias("tag"))
    tags = members.where("tag").select("bin", F.col("locus").alias("locus1"))
    others = members.select("bin", F.col("locus").alias("locus2"), (~F.col("tag")).alias("plain"))
    met = both_ways(pairs).where("locus1 <> locus2").join(tags, "locus1").join(others, ["bin", "locus2"])
    plain = F.when(F.col("plain"), F.col("r2"))
    told = met.groupBy("bin", "locus1").agg(F.least(F.min("r2"), F.lit(1.0)).alias("maxsnp"), F.sum("r2").alias("avgsnp"), F.least(F.min(plain), F.lit(1.0)).alias("maxtag"), F.sum(plain).alias("avgtag"))
    out = tags.join(told, ["bin", "locus1"], "left").withColumnRenamed("locus1", "locus")
    if scores is None:
        out = out.withColumn("score", F.lit(1.0))
    else:
        out = out.join(scores.select("locus", F.col("score").cast("double").alias("score")), "locus", "left").fillna(0.0, ["score"])
    whole = Window.partitionBy("bin")
    for name, penalty in (criteria or {}).items():
        top = F.max(name).over(whole)
        worse = top.isNotNull() & ~F.coalesce(F.abs(F.col(name) - top) <= 1e-10, F.lit(False))
        out = out.withColumn("score", F.when(worse, F.col("score") / float(penalty)).otherwise(F.col("score")))
    place = F.row_number().over(whole.orderBy(F.desc("score"), F.desc("locus")))
    return out.select("bin", F.col("locus").alias("tag"), "score", place.alias("rank"), (place <= required).alias("recommended"))


def prune(loci: DataFrame, pairs: DataFrame, max_distance: int, r2: float = 0.8, rank: str = "p") -> DataFrame:
    """Loci kept in order of ``rank`` when no kept one is in LD with them, region by region."""
    near = both_ways(pairs).where(F.col("r2") >= r2).select(F.col("locus1").alias("locus"), F.col("locus2").alias("other"))
    sets = regions(loci, max_distance).join(near, "locus", "left").groupBy("chrom", "region", "locus").agg(F.first(rank).alias("rank"), F.collect_set("other").alias("others"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: set = set()
        for locus, others in pdf.sort_values(["rank", "locus"])[["locus", "others"]].itertuples(index=False):
            if not kept.intersection(others):
                kept.add(locus)
        return pdf.loc[pdf["locus"].isin(kept), ["chrom", "region", "locus"]]

    return sets.groupBy("chrom", "region").applyInPandas(run, f"chrom {dict(loci.dtypes)['chrom']}, region long, locus {dict(loci.dtypes)['locus']}")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least name that links reach, by alternating least-neighbour steps and shortcuts, each written out."""
    work = Workspace(edges.sparkSession, "components")
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = work.table(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = work.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")).withColumnRenamed("u", "node"), "label-0")
    step = 0
    while True:
        step += 1
        near = both.join(label, both["v"] == label["node"]).groupBy("u").agg(F.min("c").alias("m"))
        next_ = label.join(near, label["node"] == near["u"], "left").select("node", F.least("c", "m").alias("c"))
        jump = next_.select(F.col("node").alias("c"), F.col("c").alias("up"))
        new = work.table(next_.join(jump, "c", "left").select("node", F.least("c", "up").alias("c")), f"label-{step}")
        changed = new.join(label.withColumnRenamed("c", "was"), "node").where("c <> was").limit(1).count()
        work.drop(f"label-{step - 1}")
        label = new
        if not changed:
            return label.select("node", F.col("c").alias("component"))


def principal_components(dosages: DataFrame, n: int = 2) -> pd.DataFrame:
    """Scores of samples on the leading components of normalised dosages (sample, locus, x).

    Loci are summed where they lie into the samples' covariance, so the driver receives sample x sample numbers; samples must be few.
    """
    samples = [r[0] for r in dosages.select("sample").distinct().orderBy("sample").collect()]
    number = dosages.sparkSession.createDataFrame([(x, i) for i, x in enumerate(samples)], f"sample {dict(dosages.dtypes)['sample']}, at int")
    called = dosages.where("x IS NOT NULL").join(F.broadcast(number), "sample")  # as few rows as samples
    rows = called.groupBy("locus").agg(F.collect_list("at").alias("at"), F.collect_list(F.col("x").cast("double")).alias("x"))

    def run(batches):
        total = np.zeros((len(samples), len(samples)))
        for batch in batches:
            for at, x in zip(batch["at"], batch["x"]):
                share = (x.sum() / 2 + 0.5) / (len(x) + 1)  # never 0 or 1
                z = np.zeros(len(samples))
                z[at] = (x - x.mean()) / np.sqrt(share * (1 - share))
                total += np.outer(z, z)
        yield pd.DataFrame({"cov": [total.tobytes()]})

    parts = rows.select("at", "x").mapInPandas(run, "cov binary").toLocalIterator()
    total = np.zeros((len(samples), len(samples)))
    for part in parts:
        total += np.frombuffer(part["cov"]).reshape(total.shape)
    values, vectors = np.linalg.eigh(total / max(1, np.trace(total)))
    top = np.argsort(values)[::-1][:n]
    return pd.DataFrame(vectors[:, top], index=samples, columns=[f"pc{i + 1}" for i in range(len(top))])

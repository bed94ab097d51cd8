"""Genotypes as a long table (sample, locus, a1, a2[, ord]): codecs, transforms, replicate merges and summaries.

Both alleles null is a missing genotype, one null is hemizygous. Alleles of a genotype have no order and
are kept sorted. Every merge is one shuffle on (sample, locus), combined before it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataloom.functions import statistics as st
from strataloom.plans.workspace import Workspace

CELL = ["sample", "locus"]


# --- codecs ------------------------------------------------------------------------------


def genotype(a1: Column, a2: Column) -> tuple[Column, Column]:
    """Alleles in order, a null one last."""
    return F.least(a1, a2), F.when(a1.isNotNull() & a2.isNotNull(), F.greatest(a1, a2))


#: Separator and missing codes of each text representation.
CODECS = {"snp": ("", ("  ", "")), "isnp": ("", ("--", "")), "hapmap": ("", ("NN", "")), "marker": ("/", ("/", "", "?/?", "0/0"))}


def decode(df: DataFrame, column: str, codec: str = "snp") -> DataFrame:
    """Replace a genotype text by a1 and a2."""
    separator, missing = CODECS[codec]
    g = F.col(f"`{column}`")
    if separator:
        parts = F.split(g, separator)
        raw = [F.nullif(F.trim(F.try_element_at(parts, F.lit(k))), F.lit("")) for k in (1, 2)]
    else:
        raw = [F.nullif(F.nullif(F.substring(g, k, 1), F.lit(" ")), F.lit("")) for k in (1, 2)]
        if codec == "hapmap":
            raw = [F.nullif(r, F.lit("N")) for r in raw]
        if codec == "isnp":
            raw = [F.nullif(r, F.lit("-")) for r in raw]
    absent = g.isNull() | g.isin(list(missing))
    a1, a2 = genotype(*[F.when(~absent, r) for r in raw])
    return df.withColumns({"a1": a1, "a2": a2}).drop(column)


def encode(a1: Column, a2: Column, codec: str = "snp") -> Column:
    separator, missing = CODECS[codec]
    blank = {"snp": " ", "isnp": "-", "hapmap": "N", "marker": ""}[codec]
    return F.when(a1.isNull() & a2.isNull(), missing[0]).otherwise(F.concat(F.coalesce(a1, F.lit(blank)), F.lit(separator), F.coalesce(a2, F.lit(blank))))


def text(df: DataFrame) -> Column:
    """The genotype as one comparable text, null if missing."""
    return F.when(F.col("a1").isNotNull() | F.col("a2").isNotNull(), F.concat(F.coalesce("a1", F.lit("")), F.coalesce("a2", F.lit(""))))


def to_matrix(df: DataFrame, rows: str = "locus", columns: list | None = None, codec: str = "snp") -> DataFrame:
    """Wide form: a column for each key of the other axis."""
    other = "sample" if rows == "locus" else "locus"
    return df.groupBy(rows).pivot(other, columns).agg(F.first(encode(F.col("a1"), F.col("a2"), codec)))


def from_matrix(df: DataFrame, rows: str = "locus", codec: str = "snp") -> DataFrame:
    other = "sample" if rows == "locus" else "locus"
    return decode(df.unpivot([rows], [c for c in df.columns if c != rows], other, "g"), "g", codec)


# --- transforms --------------------------------------------------------------------------


def keep(df: DataFrame, axis: str, names: DataFrame, exclude: bool = False) -> DataFrame:
    """Rows whose ``axis`` is, or is not, in the one-column table of names."""
    side = names.select(F.col(f"`{names.columns[0]}`").alias(axis)).distinct()
    return df.join(side, axis, "left_anti" if exclude else "left_semi")


def rename(df: DataFrame, axis: str, names: DataFrame) -> DataFrame:
    """New names from a table (old, new); others stay."""
    side = names.select(F.col(f"`{names.columns[0]}`").alias(axis), F.col(f"`{names.columns[1]}`").alias("__new"))
    return df.join(side, axis, "left").withColumn(axis, F.coalesce("__new", axis)).drop("__new").select(*df.columns)


def rename_alleles(df: DataFrame, alleles: DataFrame) -> DataFrame:
    """New alleles from a table (locus, old, new)."""
    by_locus = alleles.groupBy("locus").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__map"))
    joined = df.join(by_locus, "locus", "left")
    new = [F.coalesce(F.try_element_at("__map", c), F.col(c)) for c in ("a1", "a2")]
    a1, a2 = genotype(*new)
    return joined.withColumns({"a1": a1, "a2": a2}).select(*df.columns)


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(F.col("a1").isNotNull() | F.col("a2").isNotNull())


def drop_empty_axes(df: DataFrame) -> DataFrame:
    """Without loci, and then samples, none of whose genotypes is called."""
    called = drop_missing(df)
    rows = df.join(called.select("locus").distinct(), "locus", "left_semi")
    return rows.join(called.select("sample").distinct(), "sample", "left_semi").select(*df.columns)


def founders(df: DataFrame, pedigree: DataFrame, which: str = "founders") -> DataFrame:
    """Founders have no parents, and so have samples that the pedigree lacks; or the others."""
    children = pedigree.where("parent1 IS NOT NULL OR parent2 IS NOT NULL").select(F.col("name").alias("sample"))
    return keep(df, "sample", children, exclude=which in ("founder", "founders"))


def recode_check(df: DataFrame, alleles: DataFrame) -> DataFrame:
    """Genotypes with alleles outside the model (locus, allele)."""
    used = df.select("sample", "locus", F.explode(F.array("a1", "a2")).alias("allele")).where("allele IS NOT NULL")
    return used.join(alleles, ["locus", "allele"], "left_anti")


@dataclass
class Transform:
    """Filters, then renames, then missing genotypes, then order; each list is a one-column table and each map a two-column one."""

    include: dict[str, list[DataFrame]] = field(default_factory=dict)
    exclude: dict[str, list[DataFrame]] = field(default_factory=dict)
    rename: dict[str, DataFrame] = field(default_factory=dict)
    order: dict[str, DataFrame] = field(default_factory=dict)
    alleles: DataFrame | None = None
    pedigree: DataFrame | None = None
    founder_filter: str | None = None
    filter_missing: bool = False

    def apply(self, df: DataFrame) -> DataFrame:
        if self.founder_filter:
            df = founders(df, self.pedigree, self.founder_filter)
        for axis in CELL:  # repeated includes intersect, repeated excludes add up
            df = reduce(lambda d, n: keep(d, axis, n), self.include.get(axis, []), df)
            df = reduce(lambda d, n: keep(d, axis, n, True), self.exclude.get(axis, []), df)
        if self.alleles is not None:
            df = rename_alleles(df, self.alleles)
        for axis, names in self.rename.items():
            df = rename(df, axis, names)
        if self.filter_missing:
            df = drop_missing(df)
        return sort(df, self.order) if self.order else df


def sort(df: DataFrame, order: dict[str, DataFrame]) -> DataFrame:
    """By given places (name, place) first, then by name."""
    keys = []
    for axis in CELL:
        if axis in order:
            side = order[axis].toDF(axis, f"__{axis}")
            df = df.join(side, axis, "left")
            keys.append(F.col(f"__{axis}").asc_nulls_last())
        keys.append(F.col(axis))
    return df.orderBy(*keys).drop(*[f"__{a}" for a in CELL])


def keeps_unique(names: DataFrame) -> Column:
    """Whether a rename map (old, new) sends no two names to one; then a merge can be skipped."""
    return names.agg((F.count_distinct(names.columns[1]) == F.count(F.lit(1))).alias("unique"))


# --- merges ------------------------------------------------------------------------------

CLASSES = ("MISSING", "UNAMBIGUOUS", "CONCORDANT", "CONSENSUS", "DISCORDANT")


def _cells(df: DataFrame) -> DataFrame:
    """Counts of each called genotype in each cell, with its first place in input order."""
    order = F.min("ord") if "ord" in df.columns else F.lit(0)
    return df.withColumn("g", F.when(F.col("a1").isNotNull() | F.col("a2").isNotNull(), F.struct("a1", "a2"))).groupBy(*CELL, "g").agg(
        F.count(F.lit(1)).alias("n"), order.alias("first"))


def merge(df: DataFrame, how: str = "unanimous", threshold: float | None = None) -> DataFrame:
    """One genotype for each cell and its class, from any number of replicates.

    unique: more than one replicate raises. unanimous: all called replicates agree. vote: the most frequent
    genotype, strictly ahead of the next, with at least the threshold's share (1 by default). ordered: the first called
    genotype if it has at least the threshold's share (just under a half by default).
    """
    threshold = {"vote": 1.0, "ordered": 0.4999999}.get(how) if threshold is None else threshold
    called = F.col("g").isNotNull()
    cell = _cells(df).groupBy(*CELL).agg(
        F.sum("n").alias("replicates"), F.coalesce(F.sum(F.when(called, F.col("n"))), F.lit(0)).alias("called"),
        F.sort_array(F.collect_list(F.when(called, F.struct((-F.col("n")).alias("n"), "g"))) ).alias("ranked"),
        F.min(F.when(called, F.struct("first", F.struct("n", "g").alias("pick")))).alias("head"),
    )
    best, next_n = F.get("ranked", 0), F.coalesce(-F.get("ranked", 1)["n"], F.lit(0))
    kinds = F.size("ranked")
    if how == "unique":
        more = F.raise_error(F.concat_ws(" ", F.lit("more than one genotype for"), "sample", "locus"))
        won, g = F.when(F.col("replicates") > 1, more).otherwise(F.lit(True)), best["g"]
    elif how == "vote" and threshold < 1:
        won, g = (-best["n"] > next_n) & (-best["n"] / F.col("called") >= threshold), best["g"]
    elif how == "ordered":
        g = F.col("head.pick.g")
        won = F.col("head.pick.n") / F.col("called") >= threshold
    elif how in ("unanimous", "vote"):
        won, g = kinds == 1, best["g"]
    else:
        raise ValueError(f"no merge named {how!r}")
    kind = (
        F.when(F.col("called") == 0, "MISSING").when(F.col("replicates") == 1, "UNAMBIGUOUS").when(kinds == 1, "CONCORDANT")
        .when(F.coalesce(won, F.lit(False)), "CONSENSUS").otherwise("DISCORDANT")
    )
    chosen = F.when(won, g)
    return cell.select(*CELL, chosen["a1"].alias("a1"), chosen["a2"].alias("a2"), kind.alias("class"), "replicates", "called")


def merger(spec: str):
    """``name`` or ``name:threshold`` as a merge function."""
    name, _, threshold = spec.partition(":")
    return lambda df: merge(df, name, float(threshold) if threshold else None)


def merge_statistics(merged: DataFrame, axis: str) -> DataFrame:
    """Class counts and rates by sample or locus."""
    n = {c: F.count_if(F.col("class") == c) for c in CLASSES}
    out = merged.groupBy(axis).agg(*[n[c].alias(c.lower()) for c in CLASSES], F.count(F.lit(1)).alias("total"))
    discord = st.rate(F.col("discordant"), F.col("concordant") + F.col("consensus") + F.col("discordant"))
    missing = st.rate(F.col("missing") + F.col("discordant"), F.col("total"))
    return out.withColumns({"discord_rate": F.coalesce(discord, F.lit(0.0)), "missing_rate": missing})


# --- counts and summaries -----------------------------------------------------------------


def category(df: DataFrame | None = None) -> Column:
    called = F.when(F.col("a1").isNull(), 0).otherwise(1) + F.when(F.col("a2").isNull(), 0).otherwise(1)
    return F.when(called == 0, "missing").when(called == 1, "hemizygote").when(F.col("a1") == F.col("a2"), "homozygote").otherwise("heterozygote")


def categories(df: DataFrame, axis: str) -> DataFrame:
    kinds = ("missing", "hemizygote", "homozygote", "heterozygote")
    return df.groupBy(axis).agg(*[F.count_if(category() == k).alias(k) for k in kinds])


def genotype_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("locus", "a1", "a2").agg(F.count(F.lit(1)).alias("n"))


def allele_counts(df: DataFrame) -> DataFrame:
    """Counted from genotype counts, so that what is exploded is small."""
    alleles = genotype_counts(df).select("locus", "n", F.explode(F.array("a1", "a2")).alias("allele")).where("allele IS NOT NULL")
    return alleles.groupBy("locus", "allele").agg(F.sum("n").alias("n"))


def minor_major(df: DataFrame) -> DataFrame:
    """Least and most frequent allele of each locus with frequencies; with one allele the minor frequency is 0."""
    out = allele_counts(df).groupBy("locus").agg(
        F.min(F.struct("n", "allele")).alias("lo"), F.min(F.struct((-F.col("n")).alias("n"), "allele")).alias("hi"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"),
    )
    single = F.col("k") == 1
    return out.select(
        "locus", F.when(~single, F.col("lo.allele")).alias("minor"), F.when(single, 0.0).otherwise(F.col("lo.n") / F.col("t")).alias("minor_freq"),
        F.col("hi.allele").alias("major"), (-F.col("hi.n") / F.col("t")).alias("major_freq"),
    )


def biallelic(df: DataFrame) -> DataFrame:
    """(locus, hom1, het, hom2, hemi, missing): counts by the locus's least and greatest allele."""
    ends = df.groupBy("locus").agg(F.min(F.least("a1", "a2")).alias("lo"), F.max(F.greatest("a1", "a2")).alias("hi"))
    per = genotype_counts(df).join(ends, "locus")
    is_ = lambda a, b: (F.col("a1") == F.col(a)) & (F.col("a2") == F.col(b))
    pick = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.groupBy("locus").agg(
        pick(is_("lo", "lo")).alias("hom1"), pick((F.col("lo") != F.col("hi")) & is_("lo", "hi")).alias("het"),
        pick((F.col("lo") != F.col("hi")) & is_("hi", "hi")).alias("hom2"), pick(category() == "hemizygote").alias("hemi"), pick(category() == "missing").alias("missing"),
    )


def locus_summary(df: DataFrame, exact: bool = True, total: bool = False) -> DataFrame:
    """Counts, frequencies, missing rate, heterozygosity and equilibrium of each locus; optionally a ``*`` row."""
    counts = biallelic(df)
    if total:
        sums = [F.sum(c).alias(c) for c in ("hom1", "het", "hom2", "hemi", "missing")]
        counts = counts.withColumn("locus", F.col("locus").cast("string")).rollup("locus").agg(*sums).withColumn("locus", F.coalesce("locus", F.lit("*")))
    called = F.col("hom1") + F.col("het") + F.col("hom2") + F.col("hemi")
    p = (2 * F.col("hom1") + F.col("het")) / (2.0 * (F.col("hom1") + F.col("het") + F.col("hom2")))
    args = [F.col(c) for c in ("hom1", "het", "hom2")]
    test = st.hwp(*args) if exact else st.hwp_chisq_stat(*args)
    return counts.select(
        "locus", *args, "missing", called.alias("called"), F.least(p, 1 - p).alias("maf"), st.rate(F.col("missing"), F.col("missing") + called).alias("missing_rate"),
        st.rate(F.col("het"), called).alias("heterozygosity"), test.alias("hwp" if exact else "hwp_chisq"),
    )


def sample_summary(df: DataFrame) -> DataFrame:
    kinds = categories(df, "sample")
    called = F.col("hemizygote") + F.col("homozygote") + F.col("heterozygote")
    return kinds.select("*", st.rate(F.col("missing"), F.col("missing") + called).alias("missing_rate"), st.rate(F.col("heterozygote"), called).alias("heterozygosity"))


def completion(df: DataFrame, axis: str) -> DataFrame:
    called = F.count_if(F.col("a1").isNotNull() | F.col("a2").isNotNull())
    return df.groupBy(axis).agg(called.alias("called"), F.count(F.lit(1)).alias("total"), (called / F.count(F.lit(1))).alias("completion"))


# --- comparisons -------------------------------------------------------------------------


def ibs(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Alleles that two genotypes share, by state."""
    shared = (a1 == b1) | (a1 == b2) | (a2 == b1) | (a2 == b2)
    return F.when((a1 == b1) & (a2 == b2), 2).when(shared, 1).otherwise(0)


#: Samples of a block: all pairs of two blocks are one group of a join, whose smaller side is held in memory.
BLOCK = 4096

#: Words of 64 bits that are compared one by one; longer rows are walked through as arrays.
_UNROLLED = 64


def _packed(df: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(sample, c, g, a, h) of samples, one row each, and the words of each kind: loci called, their genotypes, alleles, and heterozygotes as bits.

    Bits stand for what is seen at a locus, whatever the number of its alleles. A cell that is there twice raises.
    """
    called = df.where("sample IS NOT NULL AND locus IS NOT NULL AND a1 IS NOT NULL AND a2 IS NOT NULL").select("sample", "locus", "a1", "a2")
    called = Workspace(df.sparkSession, "sample-pairs").table(called, "called")
    text = lambda *cs: F.to_json(F.array(*[F.col(c) if isinstance(c, str) else c for c in cs]))
    low, high = F.least("a1", "a2"), F.greatest("a1", "a2")
    kinds = called.select("locus", "a1", "a2").distinct()
    feature = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    features = F.array(feature("c", F.lit("")), feature("g", text("a1", "a2")), feature("a", text("a1")), feature("a", text("a2")), feature("h", F.when(low != high, text(low, high))))
    seen = kinds.select("locus", "a1", "a2", F.explode(F.array_distinct(features)).alias("f")).select("locus", "a1", "a2", "f.*").where("value IS NOT NULL")
    bits = seen.select("kind", "locus", "value").distinct().withColumn("bit", F.row_number().over(Window.partitionBy("kind").orderBy("locus", "value")) - 1)
    bits = Workspace(df.sparkSession, "sample-pairs").table(seen.join(bits, ["kind", "locus", "value"]).select("locus", "a1", "a2", "kind", "bit"), "bits")
    words = {r["kind"]: r["n"] // 64 + 1 for r in bits.groupBy("kind").agg(F.max("bit").alias("n")).collect()}
    of_kind = bits.groupBy("locus", "a1", "a2").agg(F.collect_list(F.struct("kind", F.expr("bit div 64").cast("int").alias("word"), F.expr("shiftleft(1L, CAST(bit % 64 AS INT))").alias("bits"))).alias("f"))
    cells = called.join(of_kind, ["locus", "a1", "a2"]).select("sample", F.explode("f").alias("f")).select("sample", "f.*")
    merged = cells.groupBy("sample", "kind", "word").agg(F.bit_or("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    twice = (F.col("kind") == "c") & (F.bit_count("bits") != F.col("n"))
    merged = merged.withColumn("bits", F.when(twice, F.raise_error(F.concat(F.lit("a cell is there twice in sample "), F.col("sample").cast("string"))).cast("bigint")).otherwise(F.col("bits")))
    rows = merged.groupBy("sample").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("word", "bits")))).alias(k) for k in "cgah"])
    dense = lambda k: F.transform(F.sequence(F.lit(0), F.lit(words.get(k, 1) - 1)), lambda w: F.coalesce(F.try_element_at(k, w.cast("int")), F.lit(0).cast("bigint")))
    return rows.select("sample", *[dense(k).alias(k) for k in "cgah"]), {k: words.get(k, 1) for k in "cgah"}


def sample_pairs(df: DataFrame, pairs: DataFrame | None = None, min_comparisons: int = 1) -> DataFrame:
    """For each pair of samples: comparisons, concordant ones, and shared alleles 0, 1, 2; of genotypes with one row a cell.

    A sample is one row of bits, and a pair is counted where its rows meet: nothing of a pair is shuffled. Blocks of samples meet, each two in one
    group. With a table of pairs (s1, s2) only those meet.
    """
    rows, words = _packed(df)
    flat = sum(words.values()) <= _UNROLLED
    if flat:
        rows = rows.select("sample", *[F.get(k, i).alias(f"{k}{i}") for k, n in words.items() for i in range(n)])
    rows = Workspace(df.sparkSession, "sample-pairs").table(rows, "rows")
    side = lambda s: rows.select(*[F.col(c).alias(f"{s}_{c}") for c in rows.columns])
    x, y = side("x"), side("y")
    if pairs is not None:
        both = pairs.join(x.withColumnRenamed("x_sample", "s1"), "s1").join(y.withColumnRenamed("y_sample", "s2"), "s2")
    else:
        n = max(-(-rows.count() // BLOCK), 1)
        parts = n * (n + 1) // 2
        own = lambda s: F.pmod(F.xxhash64(f"{s}_sample"), F.lit(n)).cast("int")
        x = x.withColumn("i", own("x")).withColumn("j", F.explode(F.sequence("i", F.lit(n - 1))))
        y = y.withColumn("j", own("y")).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
        # A given number of partitions: the few bytes that meet would be put together in a few tasks.
        both = x.repartition(parts, "i", "j").join(y.repartition(parts, "i", "j").hint("shuffle_hash"), ["i", "j"]).where("i < j OR x_sample < y_sample")
        both = both.withColumns({"s1": F.least("x_sample", "y_sample"), "s2": F.greatest("x_sample", "y_sample")})

    def common(k: str) -> Column:
        if flat:
            return reduce(lambda a, b: a + b, [F.bit_count(F.col(f"x_{k}{i}").bitwiseAND(F.col(f"y_{k}{i}"))) for i in range(words[k])])
        each = F.zip_with(f"x_{k}", f"y_{k}", lambda a, b: F.bit_count(a.bitwiseAND(b)))
        return F.aggregate(each, F.lit(0), lambda t, b: t + b)

    met = both.select("s1", "s2", common("c").cast("bigint").alias("comparisons"), common("g").cast("bigint").alias("ibs2"), (common("a") - common("h")).cast("bigint").alias("shared"))
    met = met.where(F.col("comparisons") >= max(min_comparisons, 1))
    return met.select("s1", "s2", "comparisons", (F.col("comparisons") - F.col("shared")).alias("ibs0"), (F.col("shared") - F.col("ibs2")).alias("ibs1"), "ibs2", (F.col("ibs2") / F.col("comparisons")).alias("concordance"))


def duplicates(df: DataFrame, threshold: float = 0.85, min_comparisons: int = 20, expected: DataFrame | None = None) -> DataFrame:
    """Pairs at or above the concordance threshold or expected (s1, s2), with their disposition."""
    found = sample_pairs(df, None, min_comparisons)
    if expected is not None:
        both = expected.select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), F.lit(True).alias("is_expected")).distinct()
        found = found.join(both, ["s1", "s2"], "left")
    else:
        found = found.withColumn("is_expected", F.lit(None).cast("boolean"))
    alike = F.col("concordance") >= threshold
    label = F.concat_ws(" ", F.when(F.col("is_expected"), "EXPECTED").otherwise("UNEXPECTED"), F.when(alike, "CONCORDANT").otherwise("DISCORDANT"))
    return found.where(alike | F.col("is_expected")).withColumn("disposition", label).drop("is_expected")


def allele_totals(df: DataFrame) -> DataFrame:
    """(locus, x, n): copies of one of two alleles and of both; x is null where a locus hasn't exactly two."""
    counts = allele_counts(df).groupBy("locus").agg(F.min(F.struct("allele", "n"))["n"].alias("x"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return counts.select("locus", F.when(F.col("k") == 2, F.col("x")).alias("x"), "n")


def ibd(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """Moments estimate of identity by descent from shared-allele counts and allele counts (locus, x, n).

    The expected shares of loci carry factors for sampling without replacement; loci where one isn't finite are left out.
    """
    x, n = F.col("x").cast("double"), F.col("n").cast("double")
    y = n - x
    p, q = x / n, y / n
    ratio = F.try_divide
    n2 = ratio(n, n - 1) * ratio(n, n - 2)
    n3 = n2 * ratio(n, n - 3)
    xx, yy = ratio(x - 1, x), ratio(y - 1, y)
    shares = {
        "e00": 2 * p * p * q * q * xx * yy * n3,
        "e01": (4 * p * p * p * q * xx * ratio(x - 2, x) + 4 * p * q * q * q * yy * ratio(y - 2, y)) * n3,
        "e11": (2 * p * p * q * xx + 2 * p * q * q * yy) * n2,
    }
    finite = F.col("e00").isNotNull() & F.col("e01").isNotNull() & F.col("e11").isNotNull()
    e = totals.where("n > 0").select(*[c.alias(k) for k, c in shares.items()]).where(finite).agg(*[F.avg(k).alias(k) for k in shares])
    m = F.col("comparisons")
    z0 = ratio(F.col("ibs0"), m * F.col("e00"))
    z1 = ratio(F.col("ibs1") - z0 * m * F.col("e01"), m * F.col("e11"))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = pairs.crossJoin(F.broadcast(e)).withColumns({"ibd0": clamp(z0)})  # one row of expectations
    out = out.withColumn("ibd1", F.least(clamp(z1), 1 - F.col("ibd0"))).withColumn("ibd2", 1 - F.col("ibd0") - F.col("ibd1"))
    return out.withColumn("pihat", F.col("ibd1") / 2 + F.col("ibd2")).drop(*shares)


def concordance(ref: DataFrame, comp: DataFrame, axis: str, sample_map: DataFrame | None = None, locus_map: DataFrame | None = None) -> DataFrame:
    """Concordant calls and kinds of disagreement of comparison genotypes with a reference; maps (ref, comp) may be one to many."""
    for name, names in (("sample", sample_map), ("locus", locus_map)):
        if names is not None:
            comp = comp.join(names.toDF(f"__{name}", name), name).withColumn(name, F.col(f"__{name}")).drop(f"__{name}")
    called = lambda d, s: d.where("a1 IS NOT NULL AND a2 IS NOT NULL").select(*CELL, F.col("a1").alias(f"{s}1"), F.col("a2").alias(f"{s}2"))
    both = called(ref, "r").join(called(comp, "c"), CELL)
    same = (F.col("r1") == F.col("c1")) & (F.col("r2") == F.col("c2"))
    het = {s: F.col(f"{s}1") != F.col(f"{s}2") for s in "rc"}
    kinds = {
        "het_het": ~same & het["r"] & het["c"], "het_hom": het["r"] & ~het["c"], "hom_het": ~het["r"] & het["c"], "hom_hom": ~same & ~het["r"] & ~het["c"],
    }
    return both.groupBy(axis).agg(
        F.count_if(same).alias("concordant"), *[F.count_if(c).alias(k) for k, c in kinds.items()], F.count(F.lit(1)).alias("comparisons"),
        (F.count_if(same) / F.count(F.lit(1))).alias("rate"),
    )


def mendel(df: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Transmissions to each child (child, parent1, parent2) at loci where child and at least one parent are called: consistent and all.

    A child counts only if both parents are among the samples.
    """
    present = df.select("sample").distinct()
    for parent in ("parent1", "parent2"):
        pedigree = pedigree.join(present.withColumnRenamed("sample", parent), parent, "left_semi")
    called = df.where("a1 IS NOT NULL AND a2 IS NOT NULL")
    as_ = lambda who, s: called.select(F.col("sample").alias(who), "locus", F.array("a1", "a2").alias(s), F.col("a1").alias(f"{s}1"), F.col("a2").alias(f"{s}2"))
    trio = as_("child", "c").join(pedigree.select("child", "parent1", "parent2"), "child")
    trio = trio.join(as_("parent1", "p"), ["parent1", "locus"], "left").join(as_("parent2", "q"), ["parent2", "locus"], "left")
    has = F.array_contains
    both = (has("p", F.col("c1")) & has("q", F.col("c2"))) | (has("p", F.col("c2")) & has("q", F.col("c1")))
    one = lambda s: has(s, F.col("c1")) | has(s, F.col("c2"))
    ok = F.when(F.col("p").isNotNull() & F.col("q").isNotNull(), both).when(F.col("p").isNotNull(), one("p")).when(F.col("q").isNotNull(), one("q"))
    return trio.withColumn("ok", ok).where("ok IS NOT NULL").groupBy("child").agg(F.count_if("ok").alias("consistent"), F.count(F.lit(1)).alias("total"))


def dosage(ref: Column | str) -> Column:
    """Number of alleles that are not the reference allele."""
    ref = F.lit(ref) if isinstance(ref, str) else ref
    return F.when(F.col("a1").isNotNull() & F.col("a2").isNotNull(), (F.col("a1") != ref).cast("int") + (F.col("a2") != ref).cast("int"))


def split_groups(df: DataFrame, samples: DataFrame | None = None, loci: DataFrame | None = None, default_sample: str | None = None, default_locus: str | None = None) -> DataFrame:
    """Rows with their (sample_group, locus_group); groups (name, group) may overlap; rows without one take the default or go. Write with partitionBy."""
    for axis, groups, default in (("sample", samples, default_sample), ("locus", loci, default_locus)):
        if groups is None:
            df = df.withColumn(f"{axis}_group", F.lit(default))
            continue
        df = df.join(groups.toDF(axis, f"{axis}_group"), axis, "left").withColumn(f"{axis}_group", F.coalesce(f"{axis}_group", F.lit(default)))
        df = df.where(F.col(f"{axis}_group").isNotNull())
    return df


def top_alleles(df: DataFrame, k: int = 2) -> DataFrame:
    """The k most frequent alleles of each locus."""
    w = Window.partitionBy("locus").orderBy(F.desc("n"), "allele")
    return allele_counts(df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

"""Variants against annotation tables: gene features and effects by place, known variants, names of features, and genotype probabilities from bases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataloom.operators.intervals import overlap_join

#: Bases around a transcript that count as its neighbourhood, and at an intron's ends as splice sites.
NEAR, SPLICE = 2000, 5


# --- genes -------------------------------------------------------------------------------


def gene_features(genes: DataFrame, near: int = NEAR) -> DataFrame:
    """(gene, symbol, strand, chrom, start, end, feature, number) from transcripts (gene, symbol, chrom, strand, tx_start, tx_end, cds_start, cds_end, exon_starts, exon_ends).

    Features are CDS, UTR5, UTR3 (NONCODING where the coding part is empty), intron, upstream and downstream; numbers run along the strand. Exons come in order. All is one projection.
    """
    plus = F.col("strand") == "+"
    n = F.size("exon_starts")
    exons = F.transform(F.arrays_zip(F.col("exon_starts").alias("s"), F.col("exon_ends").alias("e")), lambda x, i: F.struct(x["s"].cast("bigint").alias("s"), x["e"].cast("bigint").alias("e"), F.when(plus, i + 1).otherwise(n - i).alias("k")))
    part = lambda s, e, name, k: F.struct(s.cast("bigint").alias("start"), e.cast("bigint").alias("end"), name.alias("feature"), k.cast("int").alias("number"))
    coding = F.col("cds_start") < F.col("cds_end")
    low, high = F.col("cds_start"), F.col("cds_end")
    side = lambda first: F.when(~coding, "NONCODING").when(plus == first, "UTR5").otherwise("UTR3")
    pieces = F.flatten(F.transform(exons, lambda x: F.array(
        part(x["s"], F.when(coding, F.least(x["e"], low)).otherwise(x["e"]), side(F.lit(True)), x["k"]),
        part(F.greatest(x["s"], low), F.when(coding, F.least(x["e"], high)).otherwise(x["s"]), F.lit("CDS"), x["k"]),
        part(F.greatest(x["s"], high), F.when(coding, x["e"]).otherwise(x["s"]), side(F.lit(False)), x["k"]),
    )))
    gaps = F.zip_with(F.slice(exons, 1, F.greatest(n - 1, F.lit(0))), F.slice(exons, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: part(a["e"], b["s"], F.lit("intron"), F.least(a["k"], b["k"])))
    before = part(F.greatest(F.col("tx_start") - near, F.lit(0)), F.col("tx_start"), F.when(plus, "upstream").otherwise("downstream"), F.lit(0))
    after = part(F.col("tx_end"), F.col("tx_end") + near, F.when(plus, "downstream").otherwise("upstream"), F.lit(0))
    every = F.filter(F.concat(pieces, gaps, F.array(before, after)), lambda x: x["start"] < x["end"])
    return genes.select("gene", "symbol", "strand", "chrom", F.explode(every).alias("x")).select("gene", "symbol", "strand", "chrom", "x.*")


def annotate_variants(variants: DataFrame, genes: DataFrame, near: int = NEAR, splice: int = SPLICE) -> DataFrame:
    """(variant columns, gene, symbol, feature, number) of variants (chrom, start, end, ...) for each feature that they touch; one row with nulls where there is none.

    An insertion (start = end) touches what holds the base at its place. An intron's first and last ``splice`` bases make a touching variant a SPLICE one.
    """
    place = ["chrom", "start", "end"]
    own = variants.select("chrom", "start", F.col("end").alias("__end")).distinct().withColumn("end", F.greatest(F.col("__end"), F.col("start") + 1))
    met = overlap_join(own, gene_features(genes, near), suffix="_f")
    at_end = (F.col("start") < F.col("start_f") + splice) | (F.col("end") > F.col("end_f") - splice)
    feature = F.when((F.col("feature_f") == "intron") & at_end, "SPLICE").otherwise(F.col("feature_f"))
    found = met.select("chrom", "start", F.col("__end").alias("end"), F.col("gene_f").alias("gene"), F.col("symbol_f").alias("symbol"), feature.alias("feature"), F.col("number_f").alias("number"))
    return variants.join(found.distinct(), place, "left")


def group_evidence(annotated: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each variant, symbol and feature, its transcripts joined in order."""
    return annotated.where("gene IS NOT NULL").groupBy(*keys, "symbol", "feature").agg(F.array_join(F.sort_array(F.collect_set("gene")), ",").alias("genes"))


# --- known variants ----------------------------------------------------------------------


def known_variants(variants: DataFrame, known: DataFrame, ingroup: DataFrame | None = None) -> DataFrame:
    """Variants (chrom, start, end, alleles) with the subjects that known variants (chrom, start, end, alleles, subjects) of the same place and a shared allele have.

    ``ingroup`` is a one-column table of subjects; both lists come sorted and are empty where nothing is known.
    """
    key = ["chrom", "start", "end", "__own"]
    asked = variants.withColumn("__own", F.col("alleles"))
    hits = asked.select(*key).distinct().join(known.select(*key[:3], "alleles", "subjects"), key[:3]).where(F.arrays_overlap("__own", "alleles"))
    people = hits.select(*key, F.explode("subjects").alias("subject")).withColumn("subject", F.trim("subject")).distinct()
    if ingroup is None:
        people = people.withColumn("__in", F.lit(None).cast("boolean"))
    else:
        named = ingroup.select(F.trim(F.col(f"`{ingroup.columns[0]}`")).alias("subject"), F.lit(True).alias("__in")).distinct()
        people = people.join(named, "subject", "left")
    inside = F.coalesce("__in", F.lit(False))
    lists = people.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(inside, F.col("subject")))).alias("__i"), F.sort_array(F.collect_list(F.when(~inside, F.col("subject")))).alias("__o"))
    none = F.array().cast("array<string>")
    return asked.join(lists, key, "left").select(*variants.columns, F.coalesce("__i", none).alias("ingroup"), F.coalesce("__o", none).alias("outgroup"))


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: an aggregate that keeps one row, not a window."""
    first = F.min(F.struct(*order, F.struct(*df.columns).alias("__row")))
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(first["__row"].alias("r")).select("r.*")


def resolve_features(asked: DataFrame, genes: DataFrame, bands: DataFrame, contigs: DataFrame, snps: DataFrame) -> DataFrame:
    """Names (name) as places (name, chrom, start, end, strand, feature): the first of gene, cytoband, contig and SNP that has the name.

    Tables are (name, chrom, start, end, strand). More than one place makes a gene ``AMBIGUOUS GENE`` and a SNP ``AMBIGUOUS`` without a place; a name that none has is ``UNKNOWN``.
    """
    place = ["chrom", "start", "end", "strand"]
    names = asked.select("name").distinct()
    kinds = [(genes, "GENE", "AMBIGUOUS GENE"), (bands, "CYTOBAND", None), (contigs, "CONTIG", None), (snps, "SNP", "AMBIGUOUS")]
    every = None
    for rank, (table, kind, ambiguous) in enumerate(kinds):
        at = table.select("name", *[F.col(c) if c in table.columns else F.lit("+").alias(c) for c in place]).join(names, "name", "left_semi")
        one = at.distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("p"))
        many = F.col("n") > 1
        row = one.select("name", F.lit(rank).alias("rank"), F.when(many & F.lit(ambiguous is not None), None).otherwise(F.col("p")).alias("p"), F.when(many & F.lit(ambiguous is not None), F.lit(ambiguous)).otherwise(kind).alias("feature"))
        every = row if every is None else every.unionByName(row)
    best = every.groupBy("name").agg(F.min_by(F.struct("p", "feature"), "rank").alias("b"))
    return asked.join(best, "name", "left").select("name", *[F.col(f"b.p.{c}").alias(c) for c in place], F.coalesce("b.feature", F.lit("UNKNOWN")).alias("feature"))


def allele_sources(lines: DataFrame) -> DataFrame:
    """(chrom, location, allele, frequency, source_allele, source) from tab-separated text (value): chromosome, place, a field, major allele, its frequency, then ``allele: sources``."""
    f = F.split("value", "\t")
    pairs = F.transform(F.slice(f, 6, F.greatest(F.size(f), F.lit(1))), lambda x: F.struct(F.regexp_extract(x, "^([^:]*):(.*)$", 1).alias("a"), F.regexp_replace(F.trim(F.regexp_extract(x, "^([^:]*):(.*)$", 2)), ", ", ",").alias("s"), F.contains(x, F.lit(":")).alias("ok")))
    kept = F.filter(pairs, lambda x: x["ok"] & (x["a"] != "rsids") & ~F.startswith(x["s"], F.lit("reference")))
    chrom = F.when(F.startswith(f[0], F.lit("chr")), f[0]).otherwise(F.concat(F.lit("chr"), f[0]))
    frequency = F.coalesce(F.get(f, 4).try_cast("double"), F.lit(0.0))
    return lines.where("value <> ''").select(chrom.alias("chrom"), f[1].cast("bigint").alias("location"), F.get(f, 3).alias("allele"), frequency.alias("frequency"), F.explode(kept).alias("x")).select("chrom", "location", "allele", "frequency", F.col("x.a").alias("source_allele"), F.col("x.s").alias("source"))


# --- genotype probabilities --------------------------------------------------------------


def genotype_posteriors(bases: DataFrame, prior: float = 0.05, least_variant: int = 0) -> DataFrame:
    """(locus, ref, a, n_a, b, n_b, share_b, p_aa, p_ab, p_bb) from bases (locus, ref, base, qual) read there.

    a and b are the two most frequent bases (of ties the lesser), the reference first if it is one of them; a single other base has the reference as its
    partner, and a single reference base is certain. Variants of fewer than ``least_variant`` reads get probabilities of 0. Logarithms are added up by base before the shuffle, so deep loci are a few rows.
    """
    wrong = F.pow(F.lit(10.0), -F.col("qual") / 10.0)
    log = lambda c: F.sum(F.ln(F.greatest(c, F.lit(1e-300))))
    by_base = bases.where("base IS NOT NULL AND qual IS NOT NULL").groupBy("locus", "ref", "base").agg(F.count(F.lit(1)).alias("n"), log(1 - wrong).alias("good"), log(wrong).alias("bad"))
    ranked = by_base.groupBy("locus", "ref").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "base", "n", "good", "bad"))).alias("r"), F.sum("bad").alias("bad"))
    first, second = F.get("r", 0), F.get("r", 1)
    one, two = first["base"], F.when(second.isNotNull(), second["base"]).when(first["base"] == F.col("ref"), F.lit("N")).otherwise(F.col("ref"))
    swap = (two == F.col("ref")) | ((one != F.col("ref")) & ((F.length(one) > F.length(two)) | ((F.length(one) == F.length(two)) & (one > two))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    count = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    pick = lambda x, y: F.when(swap, y).otherwise(x)
    flat = ranked.select(
        "locus", "ref", "bad", pick(one, two).alias("a"), pick(two, one).alias("b"), pick(first["n"], count(second["n"])).alias("n_a"), pick(count(second["n"]), first["n"]).alias("n_b"),
        pick(first["good"], zero(second["good"])).alias("ga"), pick(zero(second["good"]), first["good"]).alias("gb"), pick(first["bad"], zero(second["bad"])).alias("ba"),
        pick(zero(second["bad"]), first["bad"]).alias("bb"), F.aggregate("r", F.lit(0).cast("bigint"), lambda t, x: t + x["n"]).alias("n"),
    )
    known = F.col("a") == F.col("ref")
    weight = lambda w: F.when(known, F.ln(F.lit(w))).otherwise(0.0)
    aa = F.col("ga") + F.col("bad") - F.col("ba") + weight(1 - prior)
    bb = F.col("gb") + F.col("bad") - F.col("bb") + weight(prior / 2)
    ab = F.col("ga") + F.col("gb") + F.col("bad") - F.col("ba") - F.col("bb") - F.col("n") * F.ln(F.lit(2.0)) + weight(prior / 2)
    scaled = flat.withColumns({"laa": aa, "lab": ab, "lbb": bb}).withColumn("top", F.greatest("laa", "lab", "lbb"))
    e = {k: F.exp(F.col(k) - F.col("top")) for k in ("laa", "lab", "lbb")}
    total = e["laa"] + e["lab"] + e["lbb"]
    few = (known & (F.col("n_b") < least_variant)) | (F.greatest("n_a", "n_b") < least_variant)
    certain = known & (F.col("n_b") == 0)
    p = lambda k, sure: F.when(certain, F.lit(sure)).when(few, 0.0).otherwise(e[k] / total)
    share = F.col("n_b") * 100.0 / (F.col("n_a") + F.col("n_b"))
    return scaled.select("locus", "ref", "a", "n_a", "b", "n_b", share.alias("share_b"), p("laa", 1.0).alias("p_aa"), p("lab", 0.0).alias("p_ab"), p("lbb", 0.0).alias("p_bb"))


# --- gapped alignments -------------------------------------------------------------------


def cigar(query: Column, ref: Column) -> Column:
    """Runs of M, I and D of two gapped sequences of one length; columns of two gaps are P."""
    ops = F.zip_with(F.split(query, ""), F.split(ref, ""), lambda q, r: F.when((q == "-") & (r == "-"), "P").when(q == "-", "D").when(r == "-", "I").otherwise("M"))
    runs = F.regexp_extract_all(F.array_join(ops, ""), F.lit(r"((.)\2*)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1))), "")


def trimmed_cigar(text: Column, trim: str, left: Column, right: Column) -> Column:
    """With runs of the trimming operation before and after, where they are not empty."""
    end = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit(trim))).otherwise("")
    return F.concat(end(left), text, end(right))

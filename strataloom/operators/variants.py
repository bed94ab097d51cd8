"""Variant records: parsing, flattening, filters, segregation models, merging, and lookups in annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators.intervals import margin, overlap_join

FIXED = ("chrom", "pos", "ids", "ref", "alts", "qual", "filters", "info")


def _list(c: Column, by: str) -> Column:
    return F.when((c == ".") | (c == ""), F.array().cast("array<string>")).otherwise(F.split(c, by))


def parse_vcf(lines: DataFrame, samples: list[str]) -> DataFrame:
    """Records from text lines (value): 0-based half-open places, lists, INFO as a map, genotypes as an array in sample order."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, i)
    body = lines.where("value <> '' AND value NOT LIKE '#%'")
    start = at(1).cast("bigint") - 1
    return body.select(
        F.regexp_replace(at(0), "^chr", "").alias("chrom"), start.alias("start"), (start + F.length(at(3))).alias("end"), _list(at(2), ";").alias("ids"), at(3).alias("ref"),
        _list(at(4), ",").alias("alts"), at(5).try_cast("double").alias("qual"), _list(at(6), ";").alias("filters"),
        F.when(at(7) == ".", F.create_map().cast("map<string,string>")).otherwise(F.str_to_map(at(7), F.lit(";"), F.lit("="))).alias("info"),
        F.transform(F.slice(f, 10, max(len(samples), 1)), lambda g: F.split(g, ":")[0]).alias("genos"),
    )


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    lines = spark.read.text(path)
    head = lines.where("value LIKE '#CHROM%'").limit(1).collect()
    samples = head[0]["value"].split("\t")[9:] if head else []
    return parse_vcf(lines, samples), samples


def flatten(records: DataFrame, info: list[str] = (), filters: list[str] = ()) -> DataFrame:
    """INFO keys and FILTER flags as columns."""
    return records.select(
        "chrom", "start", "end", F.array_join("ids", ";").alias("id"), "ref", F.array_join("alts", ",").alias("alt"), "qual",
        *[F.coalesce(F.try_element_at("info", F.lit(k)), F.lit("")).alias(k) for k in info], *[F.array_contains("filters", k).cast("int").alias(f"filter_{k}") for k in filters],
    )


def calls(records: DataFrame, samples: list[str]) -> DataFrame:
    """Biallelic records as long genotypes (sample, locus, a1, a2)."""
    names = F.array(*[F.lit(s) for s in samples])
    one = records.where(F.size("alts") == 1).withColumn("locus", F.coalesce(F.get("ids", 0), F.concat_ws(":", "chrom", F.col("start").cast("string"))))
    g = one.select("locus", "ref", F.get("alts", 0).alias("alt"), F.explode(F.arrays_zip(names.alias("s"), F.col("genos").alias("g"))).alias("c"))
    allele = lambda k: F.when(F.get(F.split("c.g", "[/|]"), k) == "0", F.col("ref")).when(F.get(F.split("c.g", "[/|]"), k) == "1", F.col("alt"))
    a, b = allele(0), allele(1)
    return g.select(F.col("c.s").alias("sample"), "locus", F.least(a, b).alias("a1"), F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b)).alias("a2"))


def filter_records(records: DataFrame, with_id: bool | None = None, all_of: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """By presence of an id and by FILTER terms."""
    if with_id is not None:
        records = records.where((F.size("ids") > 0) == with_id)
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    if all_of:
        records = records.where(F.size(F.array_except(lits(all_of), "filters")) == 0)
    if any_of:
        records = records.where(F.arrays_overlap("filters", lits(any_of)))
    return records.where(~F.arrays_overlap("filters", lits(none_of))) if none_of else records


#: Segregation terms by the number of reference and other alleles.
TERMS = {
    "VAR": lambda r, o: o > 0, "NOTREF": lambda r, o: (o > 0), "HOM": lambda r, o: ((r == 0) | (o == 0)) & (r + o > 0), "HET": lambda r, o: (r > 0) & (o > 0),
    "REF": lambda r, o: (r > 0) & (o == 0), "MISS": lambda r, o: r + o == 0, "NOTMISS": lambda r, o: r + o > 0,
}


def segregation(records: DataFrame, model: DataFrame, key: str, max_cost: int = 1, min_score: int = 0) -> DataFrame:
    """Keys of records whose genotypes (key, sample, ref_alleles, other_alleles) fit the model (sample, term, cost, score)."""
    joined = records.join(model, "sample")
    fits = F.lit(False)
    for name, test in TERMS.items():
        fits = F.when(F.col("term") == name, test(F.col("ref_alleles"), F.col("other_alleles"))).otherwise(fits)
    scored = joined.groupBy(key).agg(F.sum(F.when(~fits, F.col("cost")).otherwise(0)).alias("cost"), F.sum(F.when(fits, F.col("score")).otherwise(0)).alias("score"))
    return scored.where((F.col("cost") < max_cost) & (F.col("score") >= min_score))


def query_variants(variants: DataFrame, include: dict[str, list[str]] = {}, exclude: dict[str, list[str]] = {}, superset: dict[str, list[str]] = {}) -> DataFrame:  # noqa: B006
    """By list columns: some of ``include``, none of ``exclude``, all of ``superset``."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    for c, xs in include.items():
        variants = variants.where(F.arrays_overlap(c, lits(xs)))
    for c, xs in exclude.items():
        variants = variants.where(~F.coalesce(F.arrays_overlap(c, lits(xs)), F.lit(False)))
    for c, xs in superset.items():
        variants = variants.where(F.size(F.array_except(lits(xs), c)) == 0)
    return variants


def merge_sparse(calls_: DataFrame) -> DataFrame:
    """One row for each (chrom, start, end): alleles and individuals of all inputs, sorted and distinct, and the number of calls."""
    return calls_.groupBy("chrom", "start", "end").agg(
        F.array_join(F.array_sort(F.collect_set("allele")), "/").alias("alleles"), F.array_join(F.array_sort(F.collect_set("individual")), ",").alias("individuals"),
        F.count(F.lit(1)).alias("n"),
    )


def transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.least(ref, alt), F.greatest(ref, alt)).isin("AG", "CT")


def ti_tv(calls_: DataFrame) -> DataFrame:
    """Per sample: known and novel variants, transitions and transversions and their ratio."""
    ti = transition(F.col("ref"), F.col("alt"))
    out = calls_.groupBy("sample").agg(
        F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("novel"), F.count_if(ti).alias("ti"), F.count_if(~ti).alias("tv")
    )
    return out.withColumn("ratio", F.try_divide(F.col("ti").cast("double"), F.col("tv").cast("double")))


def filter_alignments(reads: DataFrame, require: int = 0, forbid: int = 0, min_mapq: int | None = None) -> DataFrame:
    """By SAM flag bits and mapping quality."""
    flag = F.col("flag")
    reads = reads.where((flag.bitwiseAND(require) == require) & (flag.bitwiseAND(forbid) == 0))
    return reads.where(F.col("mapq") >= min_mapq) if min_mapq is not None else reads


def genes_by_name(genes: DataFrame, aliases: DataFrame, name: str) -> DataFrame:
    """Genes whose alias equals, or with ``%`` is like, the name: one row for each symbol with its outermost ends."""
    match = F.col("alias").like(name) if "%" in name else F.col("alias") == name
    found = genes.join(aliases.where(match).select("symbol").distinct(), "symbol")
    return found.groupBy("symbol", "chrom").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def gene_neighborhood(features: DataFrame, genes: DataFrame, up: int, down: int) -> DataFrame:
    """Features overlapping genes widened by strand."""
    start, end = margin(F.col("strand"), F.col("start"), F.col("end"), up, down)
    return overlap_join(features, genes.withColumns({"start": start, "end": end}), width=max(64, up + down))


def annotate_left(variants: DataFrame, sources: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Successive left joins; each source's value is the sorted list of what it has for the place."""
    for name, source in sources.items():
        side = source.groupBy(*on).agg(F.array_join(F.array_sort(F.collect_set("value")), ",").alias(name))
        variants = variants.join(side, on, "left")
    return variants


def nearest_barcode(reads: DataFrame, barcodes: list[tuple[str, str]], max_error: int, min_margin: int = 1) -> DataFrame:
    """The barcode (name, sequence) nearest to each read's (id, seq); no answer beyond max_error or within the margin of the next. The list is a parameter."""
    d = F.array_sort(F.array(*[F.struct(F.levenshtein(F.col("seq"), F.lit(s)).alias("d"), F.lit(n).alias("name")) for n, s in barcodes]))
    ranked = reads.withColumn("r", d)
    best, second = F.get("r", 0), F.get("r", 1)
    sure = (best["d"] <= max_error) & (F.coalesce(second["d"] - best["d"], F.lit(1 << 20)) >= min_margin)
    return ranked.select("id", F.when(sure, best["name"]).alias("barcode"), best["d"].alias("distance"))

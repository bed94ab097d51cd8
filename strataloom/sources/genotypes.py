"""Genotype files as long tables (sample, locus, a1, a2), and intervals and sequences as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import genotypes as g
from strataloom.operators.variants import calls, read_vcf
from strataloom.sources.tables import guess_format, parse_name, read_table


def _words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))


def _pair(a: Column, b: Column, missing: tuple[str, ...] = ("0", "N", "")) -> list[Column]:
    x, y = (F.when(~c.isin(*missing), c) for c in (a, b))
    a1, a2 = g.genotype(x, y)
    return [a1.alias("a1"), a2.alias("a2")]


def read_matrix(spark: SparkSession, path: str, rows: str, codec: str = "snp", **options) -> DataFrame:
    """Text matrix: a row for each locus or sample."""
    df = read_table(spark, path, clean=False, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **options)
    return g.from_matrix(df.withColumnRenamed(df.columns[0], rows), rows, codec)


def read_triples(spark: SparkSession, path: str, codec: str = "snp", **options) -> DataFrame:
    df = read_table(spark, path, header=False, clean=False, ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", **options)
    return g.decode(df.toDF("sample", "locus", "g"), "g", codec)


def read_hapmap(spark: SparkSession, path: str) -> DataFrame:
    """Eleven metadata columns, then a column for each sample."""
    lines = _words(spark, path)
    head = lines.where(F.col("f")[0] == "rs#").limit(1).collect()
    names = F.array(*[F.lit(s) for s in (head[0]["f"][11:] if head else [])])
    body = lines.where((F.col("f")[0] != "rs#") & ~F.startswith(F.col("f")[0], F.lit("#")))
    cell = body.select(F.col("f")[0].alias("locus"), F.explode(F.arrays_zip(names.alias("s"), F.slice("f", 12, 1 << 30).alias("v"))).alias("c"))
    return g.decode(cell.select(F.col("c.s").alias("sample"), "locus", F.col("c.v").alias("g")), "g", "hapmap")


def read_ped(spark: SparkSession, path: str, map_path: str) -> DataFrame:
    """Six pedigree fields, then two alleles for each locus of the map."""
    loci = _words(spark, map_path).select(F.col("f")[1].alias("l")).collect()
    names = F.array(*[F.lit(r["l"]) for r in loci])
    alleles = F.slice("f", 7, 2 * len(loci))
    pairs = F.transform(names, lambda l, i: F.struct(l.alias("l"), F.get(alleles, 2 * i).alias("a"), F.get(alleles, 2 * i + 1).alias("b")))  # noqa: E741
    cell = _words(spark, path).select(F.col("f")[1].alias("sample"), F.explode(pairs).alias("c"))
    return cell.select("sample", F.col("c.l").alias("locus"), *_pair(F.col("c.a"), F.col("c.b")))


def read_tped(spark: SparkSession, path: str, fam_path: str) -> DataFrame:
    samples = _words(spark, fam_path).select(F.col("f")[1].alias("s")).collect()
    names = F.array(*[F.lit(r["s"]) for r in samples])
    pairs = F.transform(names, lambda s, i: F.struct(s.alias("s"), F.get("f", 2 * i + 4).alias("a"), F.get("f", 2 * i + 5).alias("b")))
    cell = _words(spark, path).select(F.col("f")[1].alias("locus"), F.explode(pairs).alias("c"))
    return cell.select(F.col("c.s").alias("sample"), "locus", *_pair(F.col("c.a"), F.col("c.b")))


def read_prettybase(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"[\s,]+")
    return spark.read.text(path).where("trim(value) <> ''").select(f[1].alias("sample"), f[0].alias("locus"), *_pair(f[2], f[3], ("N", "")))


def read_mach(spark: SparkSession, path: str, loci: list[str]) -> DataFrame:
    """Sample, a label, then ``A/C`` for each locus."""
    names = F.array(*[F.lit(x) for x in loci])
    cell = _words(spark, path).select(F.regexp_replace(F.col("f")[0], ".*->", "").alias("sample"), F.explode(F.arrays_zip(names.alias("l"), F.slice("f", 3, len(loci)).alias("v"))).alias("c"))
    return g.decode(cell.select("sample", F.col("c.l").alias("locus"), F.regexp_replace("c.v", "N", "").alias("g")), "g", "marker")


def read_eigenstrat(spark: SparkSession, geno: str, snp: str, ind: str) -> DataFrame:
    """A digit for each sample: copies of the first allele, 9 if missing. Lines are matched to loci by their place in the files."""
    samples = [r["f"][0] for r in _words(spark, ind).collect()]
    text = lambda p: spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "v")).where("trim(v) <> ''")
    loci = text(snp).select("i", F.split(F.trim("v"), r"\s+").alias("s"))
    names = F.array(*[F.lit(s) for s in samples])
    cell = text(geno).join(loci, "i").select("s", F.explode(F.arrays_zip(names.alias("n"), F.split(F.trim("v"), "").alias("d"))).alias("c")).where("c.n IS NOT NULL")
    a, b, d = F.col("s")[4], F.col("s")[5], F.col("c.d")
    first = F.when(d.isin("1", "2"), a).when(d == "0", b)
    second = F.when(d == "2", a).when(d.isin("0", "1"), b)
    x, y = g.genotype(first, second)
    return cell.select(F.col("c.n").alias("sample"), F.col("s")[0].alias("locus"), x.alias("a1"), y.alias("a2"))


def read_dosages(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(sample, locus, x) from posterior triples after marker and alleles: expected copies of the second allele."""
    names = F.array(*[F.lit(s) for s in samples])
    p = lambda i, k: F.get("f", 3 * i + 3 + k).cast("double")
    triple = F.transform(names, lambda s, i: F.struct(s.alias("s"), F.try_divide(p(i, 1) + 2 * p(i, 2), p(i, 0) + p(i, 1) + p(i, 2)).alias("x")))
    return _words(spark, path).where(F.col("f")[0] != "marker").select(F.col("f")[0].alias("locus"), F.explode(triple).alias("c")).select("c.s", "locus", "c.x").toDF("sample", "locus", "x")


def read_genotypes(spark: SparkSession, name: str, codec: str = "snp", **options) -> DataFrame:
    """Scan by format: ldat, sdat, tdat, hapmap, vcf, prettybase, or parquet in long form."""
    path, inline = parse_name(name)
    kind = options.pop("format", None) or inline.get("format") or path.rsplit(".", 1)[-1]
    if kind in ("ldat", "sdat"):
        return read_matrix(spark, path, "locus" if kind == "ldat" else "sample", codec, format="tsv", **options)
    if kind in ("tdat", "trip"):
        return read_triples(spark, path, codec, format="tsv", **options)
    if kind == "hapmap":
        return read_hapmap(spark, path)
    if kind == "vcf":
        return calls(*read_vcf(spark, path))
    if kind in ("pb", "prettybase"):
        return read_prettybase(spark, path)
    if kind == "parquet" or guess_format(path) == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no genotype format named {kind!r}")


def write_genotypes(df: DataFrame, path: str, kind: str, codec: str = "snp") -> None:
    """Long Parquet, triples, or a matrix whose columns must be few enough to stand side by side."""
    if kind == "parquet":
        df.write.parquet(path)
    elif kind in ("tdat", "trip"):
        df.select("sample", "locus", g.encode(F.col("a1"), F.col("a2"), codec)).write.options(sep="\t", header="false", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    elif kind in ("ldat", "sdat"):
        wide = g.to_matrix(df, "locus" if kind == "ldat" else "sample", None, codec)
        wide.write.options(sep="\t", header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    elif kind in ("pb", "prettybase"):
        df.select("locus", "sample", F.coalesce("a1", F.lit("N")), F.coalesce("a2", F.lit("N"))).write.options(sep="\t", header="false").csv(path)
    else:
        raise ValueError(f"no genotype format named {kind!r}")


def read_bed(spark: SparkSession, path: str, pad: int = 0) -> DataFrame:
    """(chrom, start, end, name); swapped ends are put right."""
    f = F.split("value", r"\t")
    body = spark.read.text(path).where("value <> '' AND NOT value RLIKE '^(#|track|browser)'")
    a, b = f[1].cast("bigint"), f[2].cast("bigint")
    return body.select(f[0].alias("chrom"), F.greatest(F.least(a, b) - pad, F.lit(0)).alias("start"), (F.greatest(a, b) + pad).alias("end"), F.coalesce(F.get(f, 3), F.lit("")).alias("name"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq), records split by the reader, so that a file is shared among tasks."""
    body = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''").select(F.regexp_replace("value", "^>", "").alias("v"))
    head = F.split("v", r"\r?\n", 2)
    return body.select(F.split(head[0], r"\s+")[0].alias("name"), F.regexp_replace(F.coalesce(F.get(head, 1), F.lit("")), r"\s", "").alias("seq"))


def locus_table(spark: SparkSession, name: str) -> DataFrame:
    """(locus, alleles, chrom, location, strand) from a locus file; only LOCUS is needed."""
    t = read_table(spark, name)
    t = t.toDF(*[c.upper() for c in t.columns])
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in t.columns else F.lit(None).cast("string")
    return t.select(F.col("LOCUS").alias("locus"), F.split(have("ALLELES"), ",").alias("alleles"), have("CHROMOSOME").alias("chrom"), have("LOCATION").try_cast("bigint").alias("location"), have("STRAND").alias("strand"))


def pedigree_table(spark: SparkSession, name: str) -> DataFrame:
    """(name, family, parent1, parent2, sex, pheno) from a pedigree file."""
    t = read_table(spark, name)
    t = t.toDF(*[c.upper() for c in t.columns])
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in t.columns else F.lit(None).cast("string")
    return t.select(F.coalesce(have("NAME"), have("INDIVIDUAL")).alias("name"), have("FAMILY").alias("family"), have("PARENT1").alias("parent1"), have("PARENT2").alias("parent2"), have("SEX").alias("sex"), have("PHENO").alias("pheno"))

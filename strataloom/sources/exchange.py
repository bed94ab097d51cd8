"""Text formats of other programs as long tables (sample, locus, a1, a2), conversion between formats, and what a set of genotypes holds.

Lines that hold one locus are made and read by tasks; names of the columns are a parameter or come from a small file. Writers gather one line at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import genotypes as g
from strataloom.sources import plink as pl
from strataloom.sources.genotypes import read_genotypes, write_genotypes


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("f"))


def _with_names(lines: DataFrame, values: list) -> DataFrame:
    """Lines with the array ``names``: one row beside them, for as many literals would make the plan large.

    Readers make a line's cells before they explode them: what is taken from the line afterwards would be copied, whole, to each cell.
    """
    one = lines.sparkSession.createDataFrame([([str(v) for v in values],)], "names array<string>")
    return lines.crossJoin(F.broadcast(one))


# --- probabilities and dosages -----------------------------------------------------------


def _triples(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(sample, locus, a, b, p): three probabilities after chromosome, locus, location and two alleles."""
    p = lambda i: F.array(*[F.get("f", 3 * i + 5 + k).cast("double") for k in range(3)])
    cells = F.transform("names", lambda s, i: F.struct(s.alias("s"), p(i).alias("p")))
    one = _with_names(_fields(spark, path), samples).select(F.get("f", 1).alias("locus"), F.get("f", 3).alias("a"), F.get("f", 4).alias("b"), cells.alias("c")).withColumn("c", F.explode("c"))
    return one.select(F.col("c.s").alias("sample"), "locus", "a", "b", F.col("c.p").alias("p"))


def read_probabilities(spark: SparkSession, path: str, samples: list[str], threshold: float = 0.95) -> DataFrame:
    """Genotypes whose probability is above ``threshold``, which must be a half at least; the others are missing."""
    if threshold < 0.5:
        raise ValueError("the threshold must be a half at least")
    t, p = _triples(spark, path, samples), lambda k: F.get("p", k) > threshold
    a1, a2 = g.genotype(F.when(p(0) | p(1), F.col("a")).when(p(2), F.col("b")), F.when(p(1) | p(2), F.col("b")).when(p(0), F.col("a")))
    return t.select("sample", "locus", a1.alias("a1"), a2.alias("a2"))


def read_probability_dosages(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """(sample, locus, x): expected copies of the second allele, null where all probabilities are 0."""
    p = lambda k: F.get("p", k)
    return _triples(spark, path, samples).select("sample", "locus", F.try_divide(p(1) + 2 * p(2), p(0) + p(1) + p(2)).alias("x"))


def read_dosage_table(spark: SparkSession, path: str) -> DataFrame:
    """Genotypes from dosages: a header (five fields, then samples), and for each locus its chromosome, location, alleles and copies of the second one; below 0 is missing, others round."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", r"\t").alias("f"))
    head = lines.where(F.col("f")[0] == "SNP").limit(1).collect()
    samples = [s.strip() for s in head[0]["f"][5:]] if head else []
    x = lambda i: F.get("f", i + 5).try_cast("double")
    cells = F.transform("names", lambda s, i: F.struct(s.alias("s"), F.when(x(i) >= 0, F.rint(x(i))).alias("x")))
    one = _with_names(lines.where(F.col("f")[0] != "SNP"), samples).select(F.get("f", 0).alias("locus"), F.get("f", 3).alias("a"), F.get("f", 4).alias("b"), cells.alias("c")).withColumn("c", F.explode("c"))
    copies = F.col("c.x")
    a1, a2 = g.genotype(F.when(copies == 2, F.col("b")).when(copies.isin(0, 1), F.col("a")), F.when(copies.isin(1, 2), F.col("b")).when(copies == 0, F.col("a")))
    return one.select(F.col("c.s").alias("sample"), "locus", a1.alias("a1"), a2.alias("a2"))


def _locus_lines(df: DataFrame, loci: DataFrame | None, line: Callable) -> tuple[DataFrame, list]:
    """A line for each locus from ``line(row, copies)``, copies of the second allele in the order of samples (None if missing)."""
    rows, samples = pl.by_locus(df, loci)
    place = {s: k for k, s in enumerate(samples)}

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                copies = [None] * len(place)
                for c in row.cells:
                    if c["a1"] is not None and c["a2"] is not None:
                        copies[place[c["sample"]]] = (c["a1"] != row.a) + (c["a2"] != row.a)
                out.append(line(row, copies))
            yield pd.DataFrame({"value": out})

    return rows.mapInPandas(lines, "value string"), samples


def _place(row) -> tuple[str, str]:
    return row.chrom or "0", str(int(row.location or 0))


def write_probabilities(df: DataFrame, path: str, loci: DataFrame | None = None) -> list:
    """A folder of lines with certain probabilities, all 0 where missing; gives the samples in the order of the triples."""
    shown = {None: "0 0 0", 0: "1 0 0", 1: "0 1 0", 2: "0 0 1"}
    lines, samples = _locus_lines(df, loci, lambda r, copies: " ".join([_place(r)[0], str(r.locus), _place(r)[1], r.a or "N", r.b or "N", *(shown[c] for c in copies)]))
    lines.write.text(path)
    return samples


def write_dosage_table(df: DataFrame, path: str, loci: DataFrame | None = None) -> None:
    lines, samples = _locus_lines(df, loci, lambda r, copies: "\t".join([str(r.locus), *_place(r), r.a or "", r.b or "", *("-1" if c is None else str(c) for c in copies)]))
    head = df.sparkSession.createDataFrame([("\t".join(["SNP", "Chromosome", "Position", "AlleleA", "AlleleB", *map(str, samples)]),)], "value string")
    head.coalesce(1).union(lines).write.text(path)


def write_eigenstrat(df: DataFrame, stem: str, loci: DataFrame | None = None, sexes: dict | None = None) -> None:
    """``stem``.geno, .snp and .ind: a digit for each sample, copies of the first allele, 9 if missing. Lines are written in order as they arrive."""
    both, samples = _locus_lines(df, loci, lambda r, copies: "".join("9" if c is None else str(2 - c) for c in copies) + "\n" + " ".join([str(r.locus), _place(r)[0], "0", _place(r)[1], r.a or "N", r.b or "N"]))
    with pl.create(f"{stem}.geno") as geno, pl.create(f"{stem}.snp") as snp:
        for row in both.toLocalIterator():
            digits, place = row["value"].split("\n")
            geno.write((digits + "\n").encode())
            snp.write((place + "\n").encode())
    with pl.create(f"{stem}.ind") as ind:
        ind.write("".join(f"{s} {(sexes or {}).get(s, 'U')} UNKNOWN\n" for s in samples).encode())


# --- a line or more for each sample ------------------------------------------------------


def read_linkage(spark: SparkSession, path: str, dat_path: str) -> DataFrame:
    """Five pedigree fields, then two alleles (apart or as ``a/b``) for each marker of the data file; samples are ``family:individual``."""
    markers = [r["f"] for r in _fields(spark, dat_path).where(~F.startswith(F.col("f")[0], F.lit("#"))).collect()]
    if any(m[0] != "M" or len(m) != 2 for m in markers):
        raise ValueError("only marker records (M) are read")
    alleles = F.split(F.regexp_replace(F.array_join(F.slice("f", 6, 1 << 30), " "), "/", " "), " ")  # a name may hold a slash
    apart = _with_names(_fields(spark, path), [m[1] for m in markers]).select("f", "names", alleles.alias("x"))
    cells = F.transform("names", lambda m, i: F.struct(m.alias("l"), F.get("x", 2 * i).alias("a"), F.get("x", 2 * i + 1).alias("b")))
    one = apart.select(F.concat_ws(":", F.col("f")[0], F.col("f")[1]).alias("sample"), cells.alias("c")).withColumn("c", F.explode("c"))
    known = lambda c: F.when(~F.col(c).isin("0", "x", "X", ""), F.col(c))
    a1, a2 = g.genotype(known("c.a"), known("c.b"))
    return one.select("sample", F.col("c.l").alias("locus"), a1.alias("a1"), a2.alias("a2"))


def _sample_lines(df: DataFrame, loci: DataFrame | None, lines_of: Callable) -> tuple[DataFrame, list]:
    """Lines for each sample from ``lines_of(sample, pairs)``, pairs of alleles in the order of loci; and the loci with their models."""
    order = pl.models(df, loci).orderBy(F.col("chrom").asc_nulls_first(), F.col("location").asc_nulls_first(), "locus").collect()
    place = {r["locus"]: k for k, r in enumerate(order)}

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sample, cells in zip(batch["sample"], batch["cells"]):
                pairs = [(None, None)] * len(place)
                for c in cells:
                    pairs[place[c["locus"]]] = (c["a1"], c["a2"])
                out += lines_of(sample, pairs)
            yield pd.DataFrame({"value": out})

    cells = df.groupBy("sample").agg(F.collect_list(F.struct("locus", "a1", "a2")).alias("cells")).orderBy("sample")
    return cells.mapInPandas(lines, "value string"), order


def write_linkage(df: DataFrame, stem: str, loci: DataFrame | None = None) -> None:
    """``stem``.ped (a folder) and ``stem``.dat; a sample ``family:individual`` is split again, another is a family of its own."""

    def line(sample, pairs):
        family, _, name = str(sample).rpartition(":")
        return [" ".join([family or name, name, "0", "0", "0", *(f"{a or '0'} {b or '0'}" for a, b in pairs)])]

    lines, order = _sample_lines(df, loci, line)
    lines.write.text(f"{stem}.ped")
    with pl.create(f"{stem}.dat") as out:
        out.write("".join(f"M {r['locus']}\n" for r in order).encode())


def write_structure(df: DataFrame, path: str, loci: DataFrame | None = None) -> None:
    """A folder of two lines for each sample after a line of loci: alleles as 1 and 2 by their order at the locus, -9 if missing."""
    first = {}

    def both(sample, pairs):
        code = lambda a, k: "-9" if a is None else "1" if a == first[k] else "2"
        return [" ".join([str(sample), *(code(p[side], k) for k, p in enumerate(pairs))]) for side in (0, 1)]

    order = pl.models(df, loci).orderBy(F.col("chrom").asc_nulls_first(), F.col("location").asc_nulls_first(), "locus").select("a").collect()
    first.update({k: r["a"] for k, r in enumerate(order)})
    lines, named = _sample_lines(df, loci, both)
    head = df.sparkSession.createDataFrame([(" ".join(str(r["locus"]) for r in named),)], "value string")
    head.coalesce(1).union(lines).write.text(path)


def write_phase(df: DataFrame, path: str, loci: DataFrame | None = None) -> None:
    """A folder of text: numbers of samples and loci, places, kinds, then a name and two lines of alleles for each sample, ``?`` if missing."""
    lines, order = _sample_lines(df, loci, lambda s, pairs: [f"#{s}", *(" ".join(p[side] or "?" for p in pairs) for side in (0, 1))])
    n = df.select("sample").distinct().count()
    head = [str(n), str(len(order)), " ".join(["P", *(str(r["location"] or 0) for r in order)]), "S" * len(order)]
    df.sparkSession.createDataFrame([(h,) for h in head], "value string").coalesce(1).union(lines).write.text(path)


# --- conversion and contents -------------------------------------------------------------


def convert(spark: SparkSession, sources: list[str], target: str, kind: str, codec: str = "snp", transform: g.Transform | None = None, merge: str = "unanimous") -> None:
    """Read sets of genotypes, apply a transform, merge cells that are there more than once, and write them as ``kind``."""
    every = None
    for name in sources:
        one = read_genotypes(spark, name, codec).select("sample", "locus", "a1", "a2")
        every = one if every is None else every.unionByName(one)
    if transform is not None:
        every = transform.apply(every)
    if len(sources) > 1 or (transform is not None and transform.rename):
        every = g.merger(merge)(every).select("sample", "locus", "a1", "a2")
    write_genotypes(every, target, kind, codec)


def contents(df: DataFrame) -> DataFrame:
    """One row: numbers of samples, loci, cells, called and half-called genotypes, and of loci by their number of alleles."""
    half = F.col("a1").isNotNull() & F.col("a2").isNull()
    cells = df.agg(
        F.count_distinct("sample").alias("samples"), F.count_distinct("locus").alias("loci"), F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("a1").isNotNull() & F.col("a2").isNotNull()).alias("called"), F.count_if(half).alias("half_called"),
    )
    kinds = g.allele_counts(df).groupBy("locus").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") == 1).alias("monomorphic"), F.count_if(F.col("k") == 2).alias("biallelic"), F.count_if(F.col("k") > 2).alias("multiallelic"))
    return cells.crossJoin(kinds)  # one row each

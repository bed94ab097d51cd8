"""Binary genotype matrices (bed, bim, fam) and their text forms as long tables (sample, locus, a1, a2).

A matrix is read in ranges of whole rows, so that one file is shared among tasks whatever its size; each range is read again
if its executor is lost. Writers gather one row of the matrix at a time: memory is bounded by the length of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.operators import genotypes as g

# First bytes of a matrix, its modes, and the two-bit codes (first homozygote, missing, heterozygote, second homozygote).
MAGIC, SAMPLE_MAJOR, LOCUS_MAJOR = b"\x6c\x1b", 0, 1
HOM1, MISSING, HET, HOM2 = 0, 1, 2, 3

#: Bytes that one task reads of a matrix.
RANGE_BYTES = 16 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, f): the fields of each line with its number; the file is one row of text, as its lines are numbered."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("v"))
    kept = text.select(F.posexplode(F.filter("v", lambda x: F.trim(x) != "")).alias("i", "v"))
    return kept.select(F.col("i").cast("bigint").alias("i"), F.split(F.trim("v"), r"\s+").alias("f"))


def read_bim(spark: SparkSession, path: str) -> DataFrame:
    """(i, chrom, locus, location, a, b): chromosome and alleles 0 are unknown."""
    known = lambda k: F.nullif(F.get("f", k), F.lit("0"))
    return _lines(spark, path).select("i", known(0).alias("chrom"), F.get("f", 1).alias("locus"), F.get("f", 3).cast("bigint").alias("location"), known(4).alias("a"), known(5).alias("b"))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    """(i, family, name, parent1, parent2, sex, pheno); parents 0 are unknown."""
    names = ["family", "name", "parent1", "parent2", "sex", "pheno"]
    return _lines(spark, path).select("i", *[(F.nullif(F.get("f", k), F.lit("0")) if 2 <= k <= 3 else F.get("f", k)).alias(n) for k, n in enumerate(names)])


def unpack(rows: np.ndarray, n: int) -> np.ndarray:
    """Two-bit codes, lowest bits first: (rows, bytes) to (rows, n)."""
    codes = (rows[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return codes.reshape(len(rows), -1)[:, :n]


def pack(codes: np.ndarray) -> bytes:
    padded = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    padded[: len(codes)] = codes
    return (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8).tobytes()


def _matrix_rows(spark: SparkSession, path: str, rows: int, row_bytes: int) -> DataFrame:
    """(i, row) of a matrix whose file has been checked, a range of rows for each task."""
    each = max(1, RANGE_BYTES // max(1, row_bytes))
    pieces = -(-rows // each)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, name = _open(path)
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                first, last = piece * each, min(rows, piece * each + each)
                with system.open_input_file(name) as file:
                    data = file.read_at((last - first) * row_bytes, 3 + first * row_bytes)
                cells = [data[k * row_bytes : (k + 1) * row_bytes] for k in range(last - first)]
                yield pa.record_batch([pa.array(range(first, last), pa.int64()), pa.array(cells, pa.binary())], ["i", "row"])

    return spark.range(0, pieces, 1, max(1, pieces)).mapInArrow(read, "i bigint, row binary")


def read_bed_matrix(spark: SparkSession, path: str, bim: str | None = None, fam: str | None = None) -> DataFrame:
    """Genotypes of a binary matrix of either mode. Names of the shorter axis's columns go out with the function; loci join by row or column number."""
    stem = path.removesuffix(".bed")
    loci = read_bim(spark, bim or f"{stem}.bim")
    samples = [r["name"] for r in read_fam(spark, fam or f"{stem}.fam").orderBy("i").select("name").collect()]
    system, name = _open(path)
    with system.open_input_file(name) as file:
        size, head = file.size(), file.read_at(3, 0)
    if head[:2] != MAGIC or len(head) < 3 or head[2] not in (SAMPLE_MAJOR, LOCUS_MAJOR):
        raise ValueError(f"{path} is not a binary genotype matrix")
    n_loci, locus_rows = loci.count(), head[2] == LOCUS_MAJOR
    rows, columns = (n_loci, len(samples)) if locus_rows else (len(samples), n_loci)
    row_bytes = -(-columns // 4)
    if size != 3 + rows * row_bytes:
        raise ValueError(f"{path} has {size} bytes, {3 + rows * row_bytes} are needed for {len(samples)} samples and {n_loci} loci")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = unpack(np.frombuffer(row.as_buffer(), np.uint8)[None, :], columns)[0]
                for at in range(0, columns, 100_000):
                    part = codes[at : at + 100_000]
                    places = np.arange(at, at + len(part))
                    yield pa.record_batch([np.full(len(part), i), places, part.astype(np.int32)], ["r", "c", "code"])

    long = _matrix_rows(spark, path, rows, row_bytes).mapInArrow(cells, "r bigint, c bigint, code int")
    locus_at, sample_at = ("r", "c") if locus_rows else ("c", "r")
    names = F.array(*[F.lit(s) for s in samples]) if len(samples) <= 1000 else None
    named = long.withColumnRenamed(locus_at, "i").withColumnRenamed(sample_at, "s").join(loci.select("i", "locus", "a", "b"), "i")
    if names is not None:
        named = named.withColumn("sample", F.get(names, F.col("s").cast("int")))
    else:  # a long literal array would make the plan large
        named = named.join(spark.createDataFrame(pd.DataFrame({"s": np.arange(len(samples)), "sample": samples})), "s")
    code = F.col("code")
    first = F.when(code.isin(HOM1, HET), F.col("a")).when(code == HOM2, F.col("b"))
    second = F.when(code.isin(HET, HOM2), F.col("b")).when(code == HOM1, F.col("a"))
    a1, a2 = g.genotype(first, second)
    return named.select("sample", "locus", a1.alias("a1"), a2.alias("a2"))


def models(df: DataFrame, loci: DataFrame | None) -> DataFrame:
    """(locus, chrom, location, a, b): the least and greatest allele of each locus; a third one raises."""
    alleles = g.allele_counts(df).groupBy("locus").agg(F.min("allele").alias("a"), F.max("allele").alias("b"), F.count(F.lit(1)).alias("k"))
    third = F.raise_error(F.concat(F.lit("more than two alleles at "), F.col("locus").cast("string"))).cast("string")
    known = df.select("locus").distinct().join(alleles, "locus", "left").withColumn("a", F.when(F.col("k") > 2, third).otherwise(F.col("a")))
    known = known.withColumn("b", F.when(F.col("k") > 1, F.col("b")))
    if loci is None:
        return known.select("locus", F.lit(None).cast("string").alias("chrom"), F.lit(0).cast("bigint").alias("location"), "a", "b")
    return known.join(loci.select("locus", F.col("chrom").cast("string").alias("chrom"), F.col("location").cast("bigint").alias("location")), "locus", "left").select("locus", "chrom", "location", "a", "b")


def by_locus(df: DataFrame, loci: DataFrame | None) -> tuple[DataFrame, list]:
    """Cells of each locus in the order of samples, and the samples; loci in order of chromosome, location and name."""
    samples = [r[0] for r in df.select("sample").distinct().orderBy("sample").collect()]
    cell = F.struct("sample", "a1", "a2")
    rows = df.groupBy("locus").agg(F.collect_list(cell).alias("cells")).join(models(df, loci), "locus")
    return rows.orderBy(F.col("chrom").asc_nulls_first(), F.col("location").asc_nulls_first(), "locus"), samples


def _fam_lines(samples: list, pedigree: DataFrame | None) -> list[str]:
    known = {} if pedigree is None else {r["name"]: r for r in pedigree.select("name", "family", "parent1", "parent2", "sex", "pheno").collect()}
    out = []
    for s in samples:
        r = known.get(s)
        fields = [str(s), str(s), "0", "0", "0", "0"] if r is None else [str(r["family"] or s), str(s), *[str(r[k] or "0") for k in ("parent1", "parent2", "sex", "pheno")]]
        out.append(" ".join(fields))
    return out


def _map_fields(row) -> list[str]:
    return [row["chrom"] or "0", str(row["locus"]), "0", str(row["location"] or 0)]


def write_bed_matrix(df: DataFrame, stem: str, loci: DataFrame | None = None, pedigree: DataFrame | None = None) -> None:
    """``stem``.bed, .bim and .fam of genotypes with one row a cell; absent cells are missing, a hemizygote is written as a homozygote (the format has none).

    Rows are packed by the tasks and written in order as they arrive, one at a time.
    """
    rows, samples = by_locus(df, loci)
    place = {s: k for k, s in enumerate(samples)}

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cells, a in zip(batch["cells"], batch["a"]):
                codes = np.full(len(place), MISSING, np.uint8)
                for c in cells:
                    x, y = c["a1"], c["a2"] if c["a2"] is not None else c["a1"]
                    if x is not None:
                        codes[place[c["sample"]]] = (HOM1 if x == a else HOM2) if x == y else HET
                out.append(pack(codes))
            yield batch.drop(columns="cells").assign(row=out)

    key = df.schema["locus"].dataType.simpleString()
    ready = rows.mapInPandas(packed, f"locus {key}, chrom string, location bigint, a string, b string, row binary")
    with create(f"{stem}.bed") as bed, create(f"{stem}.bim") as bim:
        bed.write(MAGIC + bytes([LOCUS_MAJOR]))
        for row in ready.toLocalIterator():
            bed.write(bytes(row["row"]))
            bim.write((" ".join([*_map_fields(row), row["a"] or "0", row["b"] or "0"]) + "\n").encode())
    with create(f"{stem}.fam") as fam:
        fam.write("".join(f"{line}\n" for line in _fam_lines(samples, pedigree)).encode())


def create(path: str):
    system, name = _open(path)
    if isinstance(system, fs.LocalFileSystem):  # the others make the folders above a file themselves
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def side_by_side(rows: DataFrame, key: str, names: list, head: list[str]) -> DataFrame:
    """A line of text for each row (head columns, cells): allele pairs in the order of ``names``, 0 where one is missing."""
    place = {n: k for k, n in enumerate(names)}

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                pairs = ["0 0"] * len(place)
                for c in row.cells:
                    pairs[place[c[key]]] = f"{'0' if c['a1'] is None else c['a1']} {'0' if c['a2'] is None else c['a2']}"
                out.append(" ".join([*(getattr(row, h) for h in head), *pairs]))
            yield pd.DataFrame({"value": out})

    return rows.mapInPandas(lines, "value string")


def write_tped(df: DataFrame, stem: str, loci: DataFrame | None = None, pedigree: DataFrame | None = None) -> None:
    """``stem``.tped (a folder of text, lines in order) and ``stem``.tfam; a missing allele is 0."""
    rows, samples = by_locus(df, loci)
    head = F.concat_ws(" ", F.coalesce("chrom", F.lit("0")), F.col("locus").cast("string"), F.lit("0"), F.coalesce("location", F.lit(0)).cast("string"))
    side_by_side(rows.select(head.alias("head"), "cells"), "sample", samples, ["head"]).write.text(f"{stem}.tped")
    with create(f"{stem}.tfam") as fam:
        fam.write("".join(f"{line}\n" for line in _fam_lines(samples, pedigree)).encode())


def write_ped(df: DataFrame, stem: str, loci: DataFrame | None = None, pedigree: DataFrame | None = None) -> None:
    """``stem``.ped (a folder of text, a line for each sample) and ``stem``.map; a line holds all loci, so they must be few enough to stand side by side."""
    order = models(df, loci).orderBy(F.col("chrom").asc_nulls_first(), F.col("location").asc_nulls_first(), "locus").collect()
    samples = df.groupBy("sample").agg(F.collect_list(F.struct("locus", "a1", "a2")).alias("cells"))
    own = F.col("sample").cast("string")
    if pedigree is None:
        head = F.concat_ws(" ", own, own, F.lit("0 0 0 0"))
    else:
        samples = samples.join(pedigree.select(F.col("name").alias("sample"), "family", "parent1", "parent2", "sex", "pheno"), "sample", "left")
        head = F.concat_ws(" ", F.coalesce("family", own), own, *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("parent1", "parent2", "sex", "pheno")])
    side_by_side(samples.select(head.alias("head"), "cells"), "locus", [r["locus"] for r in order], ["head"]).write.text(f"{stem}.ped")
    with create(f"{stem}.map") as out:
        out.write("".join(" ".join(_map_fields(r)) + "\n" for r in order).encode())


def vcf_lines(df: DataFrame, loci: DataFrame | None = None) -> DataFrame:
    """A record of text (value) for each locus in order, after the header; the reference is the least allele. Contigs 0 are unknown."""
    rows, samples = by_locus(df, loci)
    place = {n: k for k, n in enumerate(samples)}

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                code = {row.a: "0", row.b: "1", None: "."}
                genos = ["./."] * len(place)
                for c in row.cells:
                    genos[place[c["sample"]]] = f"{code[c['a1']]}/{code[c['a2']]}"
                out.append("\t".join([row.chrom or "0", str(int(row.location or 0) + 1), str(row.locus), row.a or "N", row.b or ".", ".", ".", ".", "GT", *genos]))
            yield pd.DataFrame({"value": out})

    fixed = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]
    head = ["##fileformat=VCFv4.1", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', "\t".join([*fixed, *map(str, samples)])]
    spark = df.sparkSession
    return spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).union(rows.mapInPandas(lines, "value string"))


def write_vcf(df: DataFrame, path: str, loci: DataFrame | None = None) -> None:
    """A folder of text whose parts in order are one file: the header, then records by chromosome and location."""
    vcf_lines(df, loci).write.text(path)

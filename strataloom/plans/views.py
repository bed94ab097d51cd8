"""Views of the star-schema tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def triples(spark: SparkSession, sf: str, loci: int | None = 40) -> DataFrame:
    """Replicate genotype observations."""
    flag, none = F.col("l_returnflag"), F.col("l_linenumber") == 7
    locus = F.col("l_partkey") if loci is None else F.col("l_partkey") % loci
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample"), locus.alias("locus"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(~none, F.when(flag.isin("R", "A"), "A").otherwise("B")).alias("a1"), F.when(~none, F.when(flag == "A", "A").otherwise("B")).alias("a2"),
    )


TRIP = """trip AS (SELECT l_suppkey AS sample, l_partkey % 40 AS locus, l_orderkey*10+l_linenumber AS ord,
  CASE WHEN l_linenumber=7 THEN NULL WHEN l_returnflag='R' OR l_returnflag='A' THEN 'A' ELSE 'B' END AS a1,
  CASE WHEN l_linenumber=7 THEN NULL WHEN l_returnflag='A' THEN 'A' ELSE 'B' END AS a2 FROM lineitem)"""
TRIP_PART = TRIP.replace("l_partkey % 40 AS locus", "l_partkey AS locus")
GENO = (
    TRIP
    + """, c AS (SELECT sample, locus, a1, a2, COUNT(*) AS n FROM trip WHERE a1 IS NOT NULL GROUP BY sample, locus, a1, a2),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY sample, locus ORDER BY n DESC, a1, a2) AS rn, SUM(n) OVER (PARTITION BY sample, locus) AS t,
  LEAD(n) OVER (PARTITION BY sample, locus ORDER BY n DESC, a1, a2) AS n2 FROM c),
geno AS (SELECT sample, locus, a1, a2, CASE WHEN a1 = 'B' THEN 2 WHEN a2 = 'B' THEN 1 ELSE 0 END AS x
  FROM r WHERE rn = 1 AND n > COALESCE(n2, 0) AND n * 1.0 / t >= 0.4)"""
)


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 3).alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 50 + 1).alias("end"), F.col("o_orderkey").alias("name"),
    )


def targets(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("p_partkey") * 29
    return table(spark, sf, "part").select((F.col("p_partkey") % 3).alias("chrom"), start.alias("start"), (start + F.col("p_size") + 1).alias("end"), F.col("p_partkey").alias("name"))


IV = "iv AS (SELECT o_custkey % 3 AS chrom, o_orderkey AS s, o_orderkey + o_custkey % 50 + 1 AS e, o_orderkey AS name FROM orders)"
TG = "tg AS (SELECT p_partkey % 3 AS chrom, p_partkey*29 AS s, p_partkey*29 + p_size + 1 AS e, p_partkey AS name FROM part)"


def loci(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(40).select((F.col("id") % 4).alias("chrom"), F.col("id").alias("locus"), (F.col("id") * 1000).alias("location"), F.lit(0.5).alias("maf"))


LOCI = "loci AS (SELECT i % 4 AS chrom, i AS locus, i * 1000 AS location FROM range(40) t(i))"


def pedigree(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").where(s % 5 == 0).select(s.alias("child"), (s - 1).alias("parent1"), (s - 2).alias("parent2"))


PED = "ped AS (SELECT s_suppkey AS child, s_suppkey-1 AS p1, s_suppkey-2 AS p2 FROM supplier WHERE s_suppkey % 5 = 0)"

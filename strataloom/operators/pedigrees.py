"""Nuclear families: inheritance errors by level, and the genotypes that remain possible once the impossible ones are eliminated."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from strataloom.operators import genotypes as g
from strataloom.operators.pairs import components

_POSSIBLE = ArrayType(StructType().add("sample", StringType()).add("possible", ArrayType(StringType())))


def trios(pedigree: DataFrame) -> DataFrame:
    """(parent1, parent2, child) of children with two known parents, the parents in order, from (name, parent1, parent2)."""
    both = pedigree.where("parent1 IS NOT NULL AND parent2 IS NOT NULL")
    return both.select(F.least("parent1", "parent2").alias("parent1"), F.greatest("parent1", "parent2").alias("parent2"), F.col("name").alias("child")).distinct()


def _called(genotypes: DataFrame, role: str) -> DataFrame:
    whole = genotypes.where("a1 IS NOT NULL AND a2 IS NOT NULL")
    return whole.select("locus", F.col("sample").alias(role), F.col("a1").alias(f"{role}_a"), F.col("a2").alias(f"{role}_b"))


def _fits(child: str, first: str, second: str) -> Column:
    """Whether the child's alleles can come one from each parent."""
    has = lambda who, allele: (F.col(f"{who}_a") == allele) | (F.col(f"{who}_b") == allele)
    x, y = F.col(f"{child}_a"), F.col(f"{child}_b")
    return (has(first, x) & has(second, y)) | (has(first, y) & has(second, x))


def family_errors(genotypes: DataFrame, pedigree: DataFrame) -> DataFrame:
    """(locus, parent1, parent2, child, level) of families all of whose members are called at the locus.

    Level 1: the child shares no allele with a parent. Level 2, in families without an error of level 1 there: the child shares one
    with each, but not one from each at a time.
    """
    members = trios(pedigree)
    sizes = members.groupBy("parent1", "parent2").agg(F.count(F.lit(1)).alias("children"))
    joined = members.join(_called(genotypes, "child"), "child").join(_called(genotypes, "parent1"), ["locus", "parent1"]).join(_called(genotypes, "parent2"), ["locus", "parent2"])
    shares = lambda p: F.col("child_a").isin(F.col(f"{p}_a"), F.col(f"{p}_b")) | F.col("child_b").isin(F.col(f"{p}_a"), F.col(f"{p}_b"))
    level = F.when(~shares("parent1") | ~shares("parent2"), 1).when(~_fits("child", "parent1", "parent2"), 2).otherwise(0)
    rated = joined.withColumn("level", level)
    family = ["locus", "parent1", "parent2"]
    seen = rated.groupBy(*family).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("level") == 1).cast("int")).alias("first"), F.collect_list(F.struct("child", "level")).alias("c"))
    whole = seen.join(sizes, ["parent1", "parent2"]).where("n = children").select(*family, "first", F.explode("c").alias("c"))
    return whole.select(*family, "c.child", "c.level").where((F.col("c.level") == 1) | ((F.col("c.level") == 2) & (F.col("first") == 0)))


def eliminate_family(parents: tuple, children: list, possible: dict) -> None:
    """Keep, of each member of one family, the genotypes (pairs of alleles) that some choice for all of its members contains."""
    kept = {m: set() for m in (*parents, *children)}
    for p in possible[parents[0]]:
        for q in possible[parents[1]]:
            born = {(min(x, y), max(x, y)) for x in p for y in q}
            matched = [born & possible[c] for c in children]
            if all(matched):
                kept[parents[0]].add(p)
                kept[parents[1]].add(q)
                for c, m in zip(children, matched):
                    kept[c] |= m
    possible.update(kept)


def eliminate(families: list, called: dict, alleles: list) -> dict:
    """Possible genotypes of everybody in connected families until nothing changes. Families whose members are all called are left alone."""
    everything = {(x, y) for x in alleles for y in alleles if x <= y}
    possible = {m: {called[m]} if m in called else set(everything) for p, q, children in families for m in (p, q, *children)}
    unsure = [f for f in families if not all(m in called for m in (f[0], f[1], *f[2]))]
    changed = True
    while changed:
        before = {m: len(s) for m, s in possible.items()}
        for p, q, children in unsure:
            eliminate_family((p, q), children, possible)
        changed = any(len(s) != before[m] for m, s in possible.items())
    return possible


@F.pandas_udf(_POSSIBLE)
def _eliminated(families: pd.Series, called: pd.Series, alleles: pd.Series) -> pd.Series:
    out = []
    for fs, cs, names in zip(families, called, alleles):
        known = {c["sample"]: (c["a1"], c["a2"]) for c in cs}
        left = eliminate([(f["parent1"], f["parent2"], list(f["children"])) for f in fs], known, list(names))
        out.append([{"sample": m, "possible": ["/".join(x) for x in sorted(s)]} for m, s in sorted(left.items())])
    return pd.Series(out)


def genotype_elimination(genotypes: DataFrame, pedigree: DataFrame) -> DataFrame:
    """(locus, sample, possible) for all members of families at each locus: genotypes as ``a/b``, sorted; none is an error of level 3.

    Families that share members are one group, whose size is that of a pedigree and not of the data; a locus and a group are one row. A half-called
    genotype counts as uncalled. Pedigrees without a family at all give no rows.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    members = trios(pedigree).select(text("parent1"), text("parent2"), text("child"))
    families = members.groupBy("parent1", "parent2").agg(F.sort_array(F.collect_set("child")).alias("children"))
    links = members.select(F.col("parent1").alias("x"), F.col("parent2").alias("y")).union(members.select("parent1", "child"))
    groups = components(links, "x", "y").toDF("sample", "group")
    whole = genotypes.where("a1 IS NOT NULL AND a2 IS NOT NULL").select("locus", text("sample"), "a1", "a2")
    alleles = g.allele_counts(genotypes).groupBy("locus").agg(F.sort_array(F.collect_list("allele")).alias("alleles"))
    by_group = families.join(groups.withColumnRenamed("sample", "parent1"), "parent1").groupBy("group").agg(F.collect_list(F.struct("parent1", "parent2", "children")).alias("families"))
    # a group's rows at a locus where nobody is called say nothing, so that a locus meets only groups with a call there
    called = whole.join(groups, "sample").groupBy("locus", "group").agg(F.collect_list(F.struct("sample", "a1", "a2")).alias("called"))
    ready = called.join(by_group, "group").join(alleles, "locus")
    found = ready.select("locus", F.explode(_eliminated("families", "called", "alleles")).alias("e"))
    return found.select("locus", "e.sample", "e.possible")

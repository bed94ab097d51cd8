"""Sequence functions: distances, complements, ambiguity codes, trimming and alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructType

# Ambiguity codes with their bases, and complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
COMPLEMENT = str.maketrans("ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn")


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; unequal lengths raise."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) != F.length(b), F.raise_error(F.lit("sequences of unequal length"))).otherwise(F.aggregate(same, F.lit(0), lambda s, v: s + v))


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def osa_distance(a: str, b: str) -> int:
    """Edits with transpositions of neighbours."""
    before, last, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], before[j - 2] + 1)
    return row[-1]


@pandas_udf(IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_distance(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="Int32")


def complement(seq: Column) -> Column:
    keys = "".join(chr(k) for k in COMPLEMENT)
    return F.translate(seq, keys, "".join(chr(COMPLEMENT[ord(k)]) for k in keys))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def to_iupac(bases: Column) -> Column:
    """The ambiguity code of a set of bases, given in any order."""
    code = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (v, k)])
    return F.try_element_at(code, F.array_join(F.array_sort(F.array_distinct(F.split(F.upper(bases), ""))), ""))


def base_match(a: Column, b: Column) -> Column:
    """Whether two codes share a base."""
    bases = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, v)])
    of = lambda c: F.split(F.coalesce(F.try_element_at(bases, F.upper(c)), F.lit("-")), "")
    return F.arrays_overlap(of(a), of(b))


def mismatches(a: Column, b: Column) -> Column:
    """Positions whose codes share no base."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~base_match(x, y)).cast("int")), F.lit(0), lambda s, v: s + v)


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among the valid bases."""
    valid = F.length(F.regexp_replace(F.upper(seq), "[^ACGT]", ""))
    return F.try_divide(F.length(F.regexp_replace(F.upper(seq), "[^GC]", "")).cast("double"), valid.cast("double"))


def trim_quality(quals: Column, least: int) -> Column:
    """Length kept of an array of qualities: up to the best running total of quality minus the threshold, never below 0."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("s"), F.lit(0).alias("best"), F.lit(0).alias("at"))

    def step(acc, q):
        i, s = acc["i"] + 1, F.greatest(F.lit(0), acc["s"] + q - least)
        better = s > acc["best"]
        return F.struct(i.alias("i"), s.alias("s"), F.when(better, s).otherwise(acc["best"]).alias("best"), F.when(better, i).otherwise(acc["at"]).alias("at"))

    return F.aggregate(quals.cast("array<int>"), start, step)["at"]


def align(a: str, b: str, match: int = 10, mismatch: int = -9, gap: int = -12, local: bool = True) -> tuple[int, int, int, int, int, str]:
    """Linear-gap alignment: (start and end in a, start and end in b, score, operations =, X, I, D)."""
    n, m = len(a), len(b)
    score, move = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), np.int8)
    if not local:
        score[:, 0], score[0, :] = np.arange(n + 1) * gap, np.arange(m + 1) * gap
        move[1:, 0], move[0, 1:] = 2, 3
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (score[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), score[i - 1, j] + gap, score[i, j - 1] + gap)
            best = max(options)
            if local and best <= 0:
                continue
            score[i, j], move[i, j] = best, options.index(best) + 1
    i, j = np.unravel_index(int(score.argmax()), score.shape) if local else (n, m)
    end_a, end_b, total, ops = int(i), int(j), int(score[i, j]), []
    while move[i, j]:
        k = move[i, j]
        ops.append("=X"[a[i - 1] != b[j - 1]] if k == 1 else "I" if k == 2 else "D")
        i, j = i - (k != 3), j - (k != 2)
    return int(i), end_a, int(j), end_b, total, _runs(ops[::-1])


def _runs(ops: list[str]) -> str:
    out, at = "", 0
    while at < len(ops):
        end = at
        while end < len(ops) and ops[end] == ops[at]:
            end += 1
        out, at = out + f"{end - at}{ops[at]}", end
    return out


_ALIGNED = StructType().add("start_a", IntegerType()).add("end_a", IntegerType()).add("start_b", IntegerType()).add("end_b", IntegerType()).add("score", IntegerType()).add("cigar", StringType())


@pandas_udf(_ALIGNED)
def smith_waterman(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(x, y) for x, y in zip(a, b)], columns=["start_a", "end_a", "start_b", "end_b", "score", "cigar"])


def chromosome_name(c: Column) -> Column:
    """Without a ``chr`` prefix, MT as M."""
    bare = F.regexp_replace(c, "^(?i)chr", "")
    return F.when(F.upper(bare) == "MT", "M").otherwise(bare)


def region(c: Column) -> Column:
    """``chr:start-stop`` with 1-based start as (chrom, start, stop), half-open from 0."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^([^:]+)(?::(\d+)(?:-(\d+))?)?$", k), F.lit(""))
    return F.struct(chromosome_name(part(1)).alias("chrom"), (part(2).cast("bigint") - 1).alias("start"), part(3).cast("bigint").alias("stop"))


def cytoband(c: Column) -> Column:
    """Band name as (chrom, arm, band)."""
    pattern = r"^(\d+|X|Y)([pq])([\d.]*)$"
    return F.struct(*[F.regexp_extract(c, pattern, k).alias(n) for k, n in ((1, "chrom"), (2, "arm"), (3, "band"))])


def strand(a: Column, b: Column) -> Column:
    """``Top`` where only the first of two bases is A or T, ``Bot`` where only the second is, else ``Unknown``."""
    a, b = F.upper(a), F.upper(b)
    weak = lambda c: c.isin("A", "T")
    strong = lambda c: c.isin("C", "G")
    return F.when(weak(a) & strong(b), "Top").when(weak(b) & strong(a), "Bot").otherwise("Unknown")


def strand_of_pair(a: Column, b: Column) -> Column:
    """Strand of an unordered pair of alleles, taken in alphabetical order; equal or self-complementary pairs are ``Unknown``."""
    return strand(F.least(F.upper(a), F.upper(b)), F.greatest(F.upper(a), F.upper(b)))


def snp_strand(seq: Column) -> Column:
    """(strand, a, b) of ``...[x/y]...``: by the alleles if they tell, else by the nearest pair of flanking bases at equal distance that does.

    Alleles come in alphabetical order, on the Bot strand in reverse. Other texts give nulls.
    """
    pattern = r"^([^\[]*)\[(.)[/-](.)\](.*)$"
    parts = F.struct(*[F.nullif(F.regexp_extract(F.upper(seq), pattern, k), F.lit("")).alias(f"p{k}") for k in (1, 2, 3, 4)])
    return F.get(F.transform(F.array(parts), _snp_strand), 0)  # the text is taken apart once, not at each mention of a part


def _snp_strand(parts: Column) -> Column:
    left, right = (F.coalesce(parts[k], F.lit("")) for k in ("p1", "p4"))
    low, high = F.least(parts["p2"], parts["p3"]), F.greatest(parts["p2"], parts["p3"])
    own = strand(low, high)
    n = F.least(F.length(left), F.length(right))
    outward = F.zip_with(F.split(F.left(F.reverse(left), n), ""), F.split(F.left(right, n), ""), strand)
    found = F.when(parts["p2"].isNull(), None).when(own != "Unknown", own).otherwise(F.coalesce(F.get(F.filter(outward, lambda s: s != "Unknown"), 0), F.lit("Unknown")))
    return F.get(F.transform(F.array(found), lambda s: F.struct(s.alias("strand"), F.when(s == "Bot", high).otherwise(low).alias("a"), F.when(s == "Bot", low).otherwise(high).alias("b"))), 0)


def affine_align(a: str, b: str, match: int = 10, mismatch: int = -9, opening: int = -15, extension: int = -6, local: bool = True) -> tuple[int, int, int, int, int, str]:
    """Alignment whose gaps cost ``opening`` for their first base and ``extension`` for each further one; results as of :func:`align`.

    Three scores a cell: ending in a pair, in a gap of b (I) and in a gap of a (D). Of equal scores a pair comes first, then I.
    """
    n, m, low = len(a), len(b), -(10**9)
    best = np.full((3, n + 1, m + 1), low, int)
    came = np.zeros((3, n + 1, m + 1), np.int8)  # the state before, 3 where a local alignment begins
    best[0, 0, 0], came[0, 0, 0] = 0, 3
    if not local:
        for i in range(1, n + 1):
            best[1, i, 0], came[1, i, 0] = opening + (i - 1) * extension, 1 if i > 1 else 0
        for j in range(1, m + 1):
            best[2, 0, j], came[2, 0, j] = opening + (j - 1) * extension, 2 if j > 1 else 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            before = [*(int(x) for x in best[:, i - 1, j - 1]), 0 if local else low]
            k = max(range(4), key=before.__getitem__)
            best[0, i, j], came[0, i, j] = before[k] + (match if a[i - 1] == b[j - 1] else mismatch), k
            for state, (p, q) in ((1, (i - 1, j)), (2, (i, j - 1))):
                options = [int(best[s, p, q]) + (extension if s == state else opening) for s in range(3)]
                k = max(range(3), key=options.__getitem__)
                best[state, i, j], came[state, i, j] = options[k], k
    if local:
        end = np.unravel_index(int(best[0].argmax()), best[0].shape)
        i, j, state = int(end[0]), int(end[1]), 0
        if best[0, i, j] <= 0:
            return 0, 0, 0, 0, 0, ""
    else:
        i, j, state = n, m, int(best[:, n, m].argmax())
    end_a, end_b, score, ops = i, j, int(best[state, i, j]), []
    while (i or j) and state != 3:
        ops.append("=X"[a[i - 1] != b[j - 1]] if state == 0 else "ID"[state - 1])
        i, j, state = i - (state != 2), j - (state != 1), int(came[state, i, j])
    return i, end_a, j, end_b, score, _runs(ops[::-1])


@pandas_udf(_ALIGNED)
def affine_alignment(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [affine_align(x, y) if x is not None and y is not None else (None,) * 6 for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["start_a", "end_a", "start_b", "end_b", "score", "cigar"])

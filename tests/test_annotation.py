import functools
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import sequences as sq
from strataloom.functions import statistics as st
from strataloom.operators import adjustment as ad
from strataloom.operators import annotation as an
from strataloom.operators import pairs as pr

GENES = "gene string, symbol string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, exon_starts array<long>, exon_ends array<long>"


@pytest.fixture(scope="module")
def genes(spark):
    return spark.createDataFrame(
        [("t1", "P", "1", "+", 100, 400, 130, 350, [100, 200, 300], [150, 250, 400]), ("t2", "M", "1", "-", 1000, 1300, 1050, 1250, [1000, 1200], [1100, 1300]),
         ("t3", "N", "2", "+", 10, 60, 10, 10, [10, 40], [20, 60])], GENES)


def test_gene_features(genes):
    found = sorted(tuple(r) for r in an.gene_features(genes, 50).select("gene", "start", "end", "feature", "number").collect())
    assert found == sorted([
        ("t1", 50, 100, "upstream", 0), ("t1", 100, 130, "UTR5", 1), ("t1", 130, 150, "CDS", 1), ("t1", 150, 200, "intron", 1), ("t1", 200, 250, "CDS", 2), ("t1", 250, 300, "intron", 2),
        ("t1", 300, 350, "CDS", 3), ("t1", 350, 400, "UTR3", 3), ("t1", 400, 450, "downstream", 0), ("t2", 950, 1000, "downstream", 0), ("t2", 1000, 1050, "UTR3", 2), ("t2", 1050, 1100, "CDS", 2),
        ("t2", 1100, 1200, "intron", 1), ("t2", 1200, 1250, "CDS", 1), ("t2", 1250, 1300, "UTR5", 1), ("t2", 1300, 1350, "upstream", 0),
        ("t3", 0, 10, "upstream", 0), ("t3", 10, 20, "NONCODING", 1), ("t3", 20, 40, "intron", 1), ("t3", 40, 60, "NONCODING", 2), ("t3", 60, 110, "downstream", 0),
    ])


def test_variants_in_features(spark, genes):
    variants = spark.createDataFrame([("1", 149, 151, "a"), ("1", 170, 170, "b"), ("1", 204, 205, "c"), ("1", 5000, 5001, "d"), ("1", 198, 199, "e"), ("1", 198, 199, "twin"), (None, 1, 2, "f")], "chrom string, start long, end long, name string")
    found = an.annotate_variants(variants, genes, 50)
    by_name = {}
    for r in found.collect():
        by_name.setdefault(r["name"], []).append(r["feature"])
    assert {k: sorted(x or "" for x in v) for k, v in by_name.items()} == {"a": ["CDS", "SPLICE"], "b": ["intron"], "c": ["CDS"], "d": [""], "e": ["SPLICE"], "twin": ["SPLICE"], "f": [""]}
    assert an.group_evidence(found, ["name"]).where("name = 'a'").orderBy("feature").select("symbol", "genes").collect() == [("P", "t1"), ("P", "t1")]


def test_known_variants(spark):
    known = spark.createDataFrame([("1", 5, 6, ["A", "C"], ["x", " y"]), ("1", 5, 6, ["G"], ["z"]), ("1", 5, 7, ["A"], ["w"])], "chrom string, start long, end long, alleles array<string>, subjects array<string>")
    own = spark.createDataFrame([("1", 5, 6, ["A"]), ("1", 5, 6, ["A"]), ("1", 5, 6, ["T"]), ("1", 5, 6, ["C", "G"])], "chrom string, start long, end long, alleles array<string>")
    found = sorted((r["alleles"], r["ingroup"], r["outgroup"]) for r in an.known_variants(own, known, spark.createDataFrame([("y",)], "s string")).collect())
    assert found == [(["A"], ["y"], ["x"]), (["A"], ["y"], ["x"]), (["C", "G"], ["y"], ["x", "z"]), (["T"], [], [])]


def test_names_of_features(spark):
    at = lambda *r: spark.createDataFrame(list(r), "name string, chrom string, start long, end long")
    asked = spark.createDataFrame([("g",), ("two",), ("1p1",), ("s",), ("s2",), ("?",), ("both",), ("g",)], "name string")
    found = an.resolve_features(asked, at(("g", "1", 1, 9), ("two", "1", 1, 2), ("two", "2", 1, 2), ("both", "1", 3, 4)), at(("1p1", "1", 0, 50)), at(("c", "1", 0, 99)), at(("s", "3", 7, 8), ("s2", "3", 7, 8), ("s2", "4", 7, 8), ("both", "9", 9, 10)))
    assert sorted((r["name"], r["chrom"], r["start"], r["feature"]) for r in found.collect() if r["start"] is not None) == [("1p1", "1", 0, "CYTOBAND"), ("both", "1", 3, "GENE"), ("g", "1", 1, "GENE"), ("g", "1", 1, "GENE"), ("s", "3", 7, "SNP")]
    assert sorted((r["name"], r["feature"]) for r in found.collect() if r["start"] is None) == [("?", "UNKNOWN"), ("s2", "AMBIGUOUS"), ("two", "AMBIGUOUS GENE")]


def test_allele_sources(spark):
    lines = spark.createDataFrame([("1\t55\tx\tA\t0.25\tG: p1, p2\trsids: rs1\tC: reference build\tT:q",), ("chrX\t7\tx\tC\t\tnothing",)], "value string")
    assert [tuple(r) for r in an.allele_sources(lines).collect()] == [("chr1", 55, "A", 0.25, "G", "p1,p2"), ("chr1", 55, "A", 0.25, "T", "q")]


def test_first_by(spark):
    t = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted((r["k"], r["v"]) for r in an.first_by(t, ["k"], ["o"]).collect()) == [("a", "y"), ("b", None)]


def _posterior(ref, reads, prior=0.05):
    """Probabilities from the reads one by one."""
    counts = sorted(((sum(b == x for b, _ in reads), x) for x in {b for b, _ in reads}), key=lambda c: (-c[0], c[1]))
    one = counts[0][1]
    two = counts[1][1] if len(counts) > 1 else ("N" if one == ref else ref)
    if len(counts) == 1 and one == ref:
        return one, two, (1, 0, 0)
    if two == ref or (one != ref and one > two):
        one, two = two, one
    logs = []
    for wanted, p in ((one, 1 - prior), (one + two, prior / 2), (two, prior / 2)):
        total = math.log(p) if one == ref else 0.0
        for b, q in reads:
            e = 10 ** (-q / 10)
            total += math.log((1 - e if b in wanted else e) / len(wanted))
        logs.append(total)
    top = max(logs)
    e = [math.exp(x - top) for x in logs]
    return one, two, tuple(x / sum(e) for x in e)


def test_posteriors_against_single_reads(spark):
    r = random.Random(3)
    loci = {k: ("ACGT"[k % 4], [(r.choice("AACCG" if k % 3 else "A"), r.randrange(2, 40)) for _ in range(r.randrange(1, 12))]) for k in range(40)}
    df = spark.createDataFrame([(k, ref, b, q) for k, (ref, reads) in loci.items() for b, q in reads], "locus int, ref string, base string, qual int")
    found = {x["locus"]: x for x in an.genotype_posteriors(df).collect()}
    for k, (ref, reads) in loci.items():
        a, b, p = _posterior(ref, reads)
        x = found[k]
        assert (x["a"], x["b"]) == (a, b), (k, ref, reads)
        assert (x["p_aa"], x["p_ab"], x["p_bb"]) == pytest.approx(p, abs=1e-9)
        assert x["n_a"] == sum(y == a for y, _ in reads) and x["n_b"] == sum(y == b for y, _ in reads)


def test_gapped_alignments(spark):
    t = spark.createDataFrame([("AC-GT--", "ACTG--T"), ("A", "A")], "q string, r string")
    assert [r[0] for r in t.select(an.cigar(F.col("q"), F.col("r"))).collect()] == ["2M1D1M1I1P1D", "1M"]
    assert spark.range(1).select(an.trimmed_cigar(F.lit("3M"), "S", F.lit(2), F.lit(0))).collect()[0][0] == "2S3M"


def test_triangles_and_numbers(spark):
    pairs = [(x, y) for x in range(12) for y in range(x + 1)]
    t = spark.createDataFrame(pairs, "x long, y long")
    for strict in (False, True):
        kept = [p for p in pairs if not strict or p[0] != p[1]]
        found = {(r["x"], r["y"]): r["i"] for r in t.select("x", "y", st.triangle_index(F.col("y"), F.col("x"), strict).alias("i")).collect()}
        assert {p: i for p, i in found.items() if i is not None} == {p: i for i, p in enumerate(kept)}
        back = spark.range(len(kept)).select("id", st.triangle_place(F.col("id"), strict).alias("p")).select("id", "p.*").collect()
        assert {r["id"]: (r["x"], r["y"]) for r in back} == dict(enumerate(kept))
    n = 3_000_000_007
    large = spark.range(1).select(st.triangle_place(F.lit(n * (n + 1) // 2 - 1)).alias("p"), st.triangle_place(F.lit(n * (n + 1) // 2)).alias("q")).collect()[0]
    assert tuple(large["p"]) == (n - 1, n - 1) and tuple(large["q"]) == (n, 0)
    assert st.permutations_needed(0.02, 0.2, 0.95) == math.ceil(0.98 / (0.04 * 0.02) * 1.959963984540054**2)
    v = spark.createDataFrame([(1.234,), (99.0,), (-99.0,), (float("nan"),), (None,)], "x double").select(st.scaled(F.col("x"), 100, -1000, 1000, -9999).alias("i"))
    assert [r["i"] for r in v.collect()] == [123, 1000, -1000, -9999, -9999]
    assert [r[0] for r in v.select(st.unscaled(F.col("i"), 100, -9999)).collect()] == [1.23, 10.0, -10.0, None, None]


def test_correction_by_terms(spark):
    r = np.random.default_rng(1)
    data = [(s, i, float(x), float(y), float(3 * s + 2 * x - y + e)) for s in (0, 1) for i, (x, y, e) in enumerate(r.normal(size=(60, 3)))]
    data += [(0, 60, None, 1.0, 5.0), (0, 61, 1.0, 1.0, float("nan")), (0, 62, 1.0, 0.0, 900.0), (2, 0, 1.0, 1.0, 7.0), (3, 0, 1.0, 1.0, float("nan"))]
    df = spark.createDataFrame(data, "s int, i int, x double, y double, v double")
    found = {(q["s"], q["i"]): q["corrected"] for q in ad.correct_by_terms(df, "s", "v", ["x", "y"], high=100).collect()}
    for s in (0, 1):
        rows = np.array([(x, y, v) for t, i, x, y, v in data if t == s and i < 60])
        centred = rows - rows.mean(axis=0)
        beta = np.linalg.lstsq(centred[:, :2], centred[:, 2], rcond=None)[0]
        assert [found[s, i] for i in range(60)] == pytest.approx(list(rows[:, 2] - centred[:, :2] @ beta))
    assert found[0, 60] is None and found[2, 0] == 7.0 and found[0, 62] == pytest.approx(900, rel=0.1) and math.isnan(found[3, 0])


def test_penalised_paths(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] + r.normal(size=200) * 0.1
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    path = {(p["penalty"], p["term"]): p["beta"] for p in ad.elastic_net(df, "y", ["a", "b"], [0.0, 0.5, 100.0]).collect()}
    plain = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [path[0.0, t] for t in ("intercept", "a", "b")] == pytest.approx(list(plain), abs=1e-6)
    assert path[0.5, "b"] == 0 and 0 < path[0.5, "a"] < plain[1] and path[100.0, "a"] == 0


def test_variable_kinds(spark):
    df = spark.createDataFrame([(1.0, 0, i, i % 4, None) for i in range(10)] + [(1.0, 1, None, 0, None)], "a double, b int, c int, d int, e int")
    kinds = [ad.variable_summary(df, c).collect()[0] for c in "abcde"]
    assert [k["kind"] for k in kinds] == ["constant", "binary", "continuous", "categorical", "empty"]
    assert (kinds[2]["n"], kinds[2]["mean"], kinds[2]["median"]) == (10, 4.5, 4.5) and kinds[2]["sd"] == pytest.approx(np.std(range(10)))


def test_ancestry(spark):
    f = np.random.default_rng(4).uniform(0.05, 0.95, size=(300, 2))
    shares, top = ad.mixing_shares(f)
    grid = max((np.log(f @ np.array([a, 1 - a])).sum(), a) for a in np.linspace(0, 1, 2001))
    assert top >= grid[0] - 1e-9 and shares[0] == pytest.approx(grid[1], abs=1e-3) and shares.sum() == pytest.approx(1)
    rows = [(f"{p}{i}", x, (x + i) % 3 if p == "a" else min(2, (x + i) % 4)) for p, i, x in itertools.product("ab", range(6), range(30))]
    dosages = spark.createDataFrame(rows, "sample string, locus int, x int")
    groups = spark.createDataFrame([(f"{p}{i}", p) for p in "ab" for i in range(6)], "sample string, population string")
    for model in ("HWP", "GENO"):
        freq = ad.population_frequencies(dosages, groups, model)
        total = freq.groupBy("locus", "population").agg(F.sum("f").alias("t")).agg(F.max(F.abs(F.col("t") - 1))).collect()[0][0]
        assert total < 1e-12
        found = ad.admixture(dosages, freq).groupBy("sample").agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        assert len(found) == 12 and all(q["s"] == pytest.approx(1) and q["n"] == 2 for q in found)
    with pytest.raises(ValueError):
        ad.population_frequencies(dosages, groups, "?")


def test_shares_of_many_groups_at_once(spark):
    r = np.random.default_rng(5)
    groups = [r.uniform(0, 1, size=(n, 3)) for n in (1, 7, 40, 40, 13)] + [np.full((4, 3), 0.5)]
    shares, loglik = ad.many_mixing_shares(groups, 500)
    for f, own, top in zip(groups, shares, loglik):
        x = np.full(3, 1 / 3)
        for _ in range(500):
            new = x * (f / (f @ x)[:, None]).mean(axis=0)
            done, x = np.abs(new - x).max() < 1e-12, new
            if done:
                break
        assert own == pytest.approx(x, abs=1e-9) and top == pytest.approx(np.log(f @ x).sum())
    dosages = spark.createDataFrame([(s, i, (s * i) % 3) for s in range(40) for i in range(s % 7 + 1)], "sample int, locus int, x int")
    freq = ad.population_frequencies(dosages, spark.createDataFrame([(s, s % 2) for s in range(40)], "sample int, population int")).withColumn("f", F.col("f") + 0.01)
    found = ad.admixture(dosages, freq)
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # a call of Python for each sample
    assert found.count() == 80


def _best_score(a, b, local):
    """Score of the best alignment from all ways to go on."""

    @functools.cache
    def go(i, j, state):  # the best of what is left of a and b after a pair (0) or in a gap
        out = [0] if local or (i == len(a) and j == len(b)) else []
        if i < len(a) and j < len(b):
            out.append((10 if a[i] == b[j] else -9) + go(i + 1, j + 1, 0))
        if i < len(a):
            out.append((-6 if state == 1 else -15) + go(i + 1, j, 1))
        if j < len(b):
            out.append((-6 if state == 2 else -15) + go(i, j + 1, 2))
        return max(out)

    return max(go(i, j, 0) for i in range(len(a) + 1) for j in range(len(b) + 1)) if local else go(0, 0, 0)


def test_affine_gaps_against_all_ways(spark):
    r = random.Random(8)
    for k in range(150):
        a, b = ("".join(r.choice("ACG" if k % 2 else "AC") for _ in range(r.randrange(0, 9))) for _ in "ab")
        for local in (True, False):
            i, x, j, y, score, text = sq.affine_align(a, b, local=local)
            assert score == _best_score(a, b, local), (a, b, local)
            again, p, q = 0, i, j
            for n, op in re.findall(r"(\d+)(.)", text):
                for t in range(int(n)):
                    if op in "=X":
                        assert (a[p] == b[q]) == (op == "=")
                        again += 10 if op == "=" else -9
                    else:
                        again += -6 if t else -15
                    p, q = p + (op != "D"), q + (op != "I")
            assert (again, p, q) == (score, x, y), (a, b, local, text)
    df = spark.createDataFrame([("GATTACA", "GACA"), (None, "A")], "a string, b string").select(sq.affine_alignment(F.col("a"), F.col("b")).alias("r"))
    assert [x["r"]["score"] for x in df.collect()] == [sq.affine_align("GATTACA", "GACA")[4], None]


def test_ranks_of_tags(spark):
    bins = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "c", False), (2, "z", True)], "bin int, locus string, tag boolean")
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.85)], "locus1 string, locus2 string, r2 double")
    ranked = lambda *args, **kw: [(r["bin"], r["tag"], r["score"], r["recommended"]) for r in pr.rank_tags(bins, pairs, *args, **kw).orderBy("bin", "rank").collect()]
    assert ranked() == [(1, "b", 1.0, True), (1, "a", 1.0, False), (2, "z", 1.0, True)]
    assert ranked(None, {"maxtag": 4}) == [(1, "b", 1.0, True), (1, "a", 0.25, False), (2, "z", 1.0, True)]
    scores = spark.createDataFrame([("a", 8.0)], "locus string, score double")
    assert ranked(scores, {"avgsnp": 2}, 2) == [(1, "a", 4.0, True), (1, "b", 0.0, True), (2, "z", 0.0, True)]

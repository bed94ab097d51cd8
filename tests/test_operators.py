import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import compare
from strataloom import catalog
from strataloom.functions import sequences as sq
from strataloom.functions import statistics as st
from strataloom.operators import columns as co
from strataloom.operators import genotypes as g
from strataloom.operators import pairs as pr
from strataloom.operators import regression as rg
from strataloom.operators import tables as tb
from strataloom.sources import genotypes as sg
from strataloom.sources import tables as src


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_column_resolution():
    h = ["a", "b", "c-d", "4"]
    assert co.resolve(h, "c-d,a") == [2, 0]
    assert co.resolve(h, "a-c-d") == [0, 1, 2]
    assert co.resolve(h, "2,*") == [1, 0, 2, 3]
    assert co.resolve(h, "4") == [3]  # a header wins over a number
    assert co.resolve(h, "b-", "c-d") == [1, 3]
    with pytest.raises(ValueError):
        co.resolve(h, "9")


def test_expressions(spark):
    t = spark.createDataFrame([("1", "M", ""), ("2", "F", ""), ("3", "?", "1")], "a string, b string, c string")
    assert rows(tb.filter_expr(t, "int(a) > 1 and b == 'F'")) == [("2", "F", "")]
    assert rows(tb.filter_expr(t, "c")) == [("3", "?", "1")]
    assert rows(tb.column_exprs(t, ["d=int(a) * 2", "e=d + b.lower()"]).select("d", "e"), "d") == [("2", "2m"), ("4", "4f"), ("6", "6?")]
    for bad in ("__import__('os')", "a.__class__", "(lambda: 1)()", "open(a)"):
        with pytest.raises(ValueError):
            tb.filter_expr(t, bad)


def test_indicators_and_sort(spark):
    t = spark.createDataFrame([("9e9", "M"), ("-9", "F"), ("abc", ""), ("", "M")], "x string, s string")
    assert [r[0] for r in rows(tb.sort_table(t, "x"))] == ["-9", "9e9", "", "abc"]
    coded = tb.indicators(t, "s", ref=["F"], missing="?")
    assert rows(coded.select("x", "s_M"), "x") == [("", "1"), ("-9", "0"), ("9e9", "1"), ("abc", "?")]
    u = spark.createDataFrame([("1", 1), ("1.0", 2), ("b", 3)], "x string, o long")
    assert rows(tb.uniq_table(u, "x", ["o"]), "o") == [("1", 1), ("b", 3)]


def test_join_blank_keys(spark):
    a = spark.createDataFrame([("1", "2"), ("1", "3"), ("2", "1"), ("", "")], "A string, B string")
    b = spark.createDataFrame([("3", "1"), ("", "1"), ("2", "0")], "B string, C string")
    assert rows(tb.join_tables(a, b), "A", "B") == [("", "", ""), ("1", "2", "0"), ("1", "3", "1"), ("2", "1", "")]
    twice = spark.createDataFrame([("3", "1"), ("3", "2")], "B string, C string")
    with pytest.raises(Exception, match="duplicate key"):
        tb.join_tables(a, twice, unique=True).collect()


def test_merges(spark):
    t = spark.createDataFrame(
        [("s", "l", 1, "A", "B"), ("s", "l", 2, "A", "B"), ("s", "l", 3, "A", "A"), ("s", "m", 1, None, None), ("s", "n", 1, "A", "A"), ("s", "n", 2, None, None), ("s", "o", 1, "B", None)],
        "sample string, locus string, ord int, a1 string, a2 string",
    )
    got = lambda how, th=None: {r["locus"]: (r["a1"], r["a2"], r["class"]) for r in g.merge(t, how, th).collect()}
    assert got("unanimous") == {"l": (None, None, "DISCORDANT"), "m": (None, None, "MISSING"), "n": ("A", "A", "CONCORDANT"), "o": ("B", None, "UNAMBIGUOUS")}
    assert got("vote", 0.5)["l"] == ("A", "B", "CONSENSUS")
    assert got("vote")["l"] == (None, None, "DISCORDANT")
    assert got("ordered")["l"] == ("A", "B", "CONSENSUS")
    with pytest.raises(Exception, match="more than one genotype"):
        g.merge(t, "unique").collect()


def test_codecs(spark):
    t = spark.createDataFrame([("BA",), ("  ",), ("A ",)], "g string")
    assert rows(g.decode(t, "g", "snp")) == [("A", "B"), (None, None), ("A", None)]
    m = spark.createDataFrame([("T/A",), ("/",)], "g string")
    assert rows(g.decode(m, "g", "marker")) == [("A", "T"), (None, None)]


def test_mendel_and_ibs(spark):
    t = spark.createDataFrame([("c", 1, "A", "B"), ("p", 1, "A", "A"), ("q", 1, "B", "B"), ("c", 2, "B", "B"), ("p", 2, "A", "A")], "sample string, locus int, a1 string, a2 string")
    ped = spark.createDataFrame([("c", "p", "q")], "child string, parent1 string, parent2 string")
    assert rows(g.mendel(t, ped)) == [("c", 1, 2)]
    p = {(r["s1"], r["s2"]): (r["ibs0"], r["ibs1"], r["ibs2"]) for r in g.sample_pairs(t).collect()}
    assert p[("c", "p")] == (1, 1, 0) and p[("p", "q")] == (1, 0, 0)


@pytest.mark.parametrize(("block", "unrolled"), [(8, 64), (8, 0), (4096, 64)])
def test_pairs_in_blocks_against_single_cells(spark, monkeypatch, block, unrolled):
    monkeypatch.setattr(g, "BLOCK", block)
    monkeypatch.setattr(g, "_UNROLLED", unrolled)
    r = random.Random(3)
    kinds = [("A", "A"), ("A", "B"), ("B", "A"), ("B", "B"), ("A", "C"), ("C", "C"), ("B", "C"), ("D", "E"), ("A", None), (None, None)]
    cells = {(f"s{s}", k): r.choice(kinds) for s in range(30) for k in range(70) if r.random() < 0.8}
    df = spark.createDataFrame([(*c, *v) for c, v in cells.items()], "sample string, locus int, a1 string, a2 string")
    want = {}
    for s, t in itertools.combinations(sorted({c[0] for c in cells}), 2):
        n = [0, 0, 0]
        for k in range(70):
            x, y = cells.get((s, k)), cells.get((t, k))
            if x and y and None not in x and None not in y:
                n[2 if x == y else 1 if set(x) & set(y) else 0] += 1
        want[s, t] = (sum(n), *n)
    tell = lambda found: {(q["s1"], q["s2"]): (q["comparisons"], q["ibs0"], q["ibs1"], q["ibs2"]) for q in found.collect()}
    found = g.sample_pairs(df)
    assert found.count() == len(want) and tell(found) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan  # rows of pairs are not shuffled
    some = [("s3", "s11"), ("s11", "s3"), ("s5", "s5"), ("s1", "none")]
    few = tell(g.sample_pairs(df, spark.createDataFrame(some, "s1 string, s2 string"), 2))
    assert few.keys() == set(some[:3]) and few["s3", "s11"] == few["s11", "s3"] == want["s11", "s3"]
    assert {k for k, v in want.items() if v[0] >= 33} == tell(g.sample_pairs(df, None, 33)).keys()


def test_a_spread_join_is_the_join(spark):
    a = spark.createDataFrame([(k % 3 if k % 7 else None, f"a{k}") for k in range(40)], "k int, v string")
    b = spark.createDataFrame([(k % 4 if k % 5 else None, f"b{k}") for k in range(60)], "j int, w string")
    tell = lambda n: sorted(map(tuple, tb.join_tables(a, b, ["k"], ["j"], "inner", prefix2="r_", spread=n).collect()))
    assert tell(5) == tell(1) and len(tell(5)) > 300
    with pytest.raises(ValueError):
        tb.join_tables(a, b, ["k"], ["j"], spread=2)


def test_a_cell_twice_is_told(spark):
    twice = spark.createDataFrame([("s", 1, "A", "A"), ("s", 1, "A", "B"), ("t", 1, "A", "A")], "sample string, locus int, a1 string, a2 string")
    with pytest.raises(Exception, match="there twice"):
        g.sample_pairs(twice).collect()


def test_equilibrium():
    assert st.hwp_exact(0, 0, 0) == 1.0
    assert abs(st.hwp_exact(5, 10, 5) - 1.0) < 1e-9
    assert st.hwp_exact(10, 0, 10) < 1e-4
    assert abs(st.chisq_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(st.chisq_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(st.t_sf2(2.0, 10) - 0.07338803477074039) < 1e-9
    low, high = st.jeffreys_interval(0, 10)
    assert low == 0 and abs(high - 0.2171966750921) < 1e-6


def test_ld():
    r2, d = st.estimate_ld(np.array([10, 5, 10]), np.array([0, 5, 0]), np.array([0, 5, 0]), np.array([10, 5, 0]), np.array([0, 0, 0]))
    assert np.allclose(r2, [1, 0, 0]) and np.allclose(d, [1, 0, 0])


def test_greedy():
    found = pr._greedy({"a": ["b", "c"], "b": ["a"], "c": ["a"], "d": ["e"], "e": ["d"]}, {"d": 0.1, "e": 0.4})
    assert [(t, m) for t, m, *_ in found] == [("a", "a"), ("a", "b"), ("a", "c"), ("e", "d"), ("e", "e")]


def test_regression():
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(400), rng.normal(size=400)])
    y = x @ [1.0, 2.0] + rng.normal(size=400)
    m = rg.linear(y, x)
    assert np.allclose(m["beta"], np.linalg.lstsq(x, y, rcond=None)[0])
    c = (rng.random(400) < 1 / (1 + np.exp(-(x @ [0.3, 1.1])))).astype(float)
    fit = rg.logistic(c, x)
    p = 1 / (1 + np.exp(-x @ fit["beta"]))
    assert np.abs(x.T @ (c - p)).max() < 1e-6
    both = rg.multinomial(c, x)
    assert np.allclose(both["beta"], fit["beta"], atol=1e-6) and abs(both["loglike"] - fit["loglike"]) < 1e-6
    t = rg.tests(c, x, [1], rg.logistic)
    assert all(v > 10 for v, _ in t.values()) and abs(t["lr"][0] - t["wald"][0]) < 0.5 * t["lr"][0]


def test_formula():
    assert rg.parse_formula("y = GENO(locus) + age*sex + 0") == ("y", [[("GENO", "locus")], [("age", ""), ("sex", "")]], False)


def test_sequences(spark):
    assert sq.osa_distance("ca", "abc") == 3 and sq.osa_distance("abcd", "acbd") == 1
    assert sq.align("ACGT", "ACGT")[4:] == (40, "4=")
    assert sq.align("ACGT", "AGT", local=False)[4] == 30 - 12
    t = spark.createDataFrame([("ACGTN", "ACGTA")], "a string, b string")
    r = t.select(sq.reverse_complement(F.col("a")), sq.mismatches(F.col("a"), F.col("b")), sq.hamming(F.col("a"), F.col("b")), sq.to_iupac(F.lit("GA"))).first()
    assert tuple(r) == ("NACGT", 0, 1, "R")


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n 1 ,x\n2\n")
    t = src.read_table(spark, f"{tmp_path}/t.csv:columns=b,a:rename=a=z")
    assert t.columns == ["b", "z"] and rows(t, "z") == [("x", "1"), ("", "2")]
    assert rows(src.read_list(spark, ":a,b,,c")) == [("a",), ("b",), ("c",)]
    assert src.parse_name("file.gz:foo=bar:baz") == ("file.gz", {"foo": "bar", "baz": ""})
    assert src.guess_format("x.csv.gz") == "csv"
    (tmp_path / "s.txt").write_text("[one]\na\tb\n[two]\nc\n")
    assert rows(src.read_sections(spark, f"{tmp_path}/s.txt").select("section", "fields"), "section") == [("one", ["a", "b"]), ("two", ["c"])]
    (tmp_path / "x.ldat").write_text("ldat\ts1\ts2\nl1\tAG\t  \nl2\tTT\tAT\n")
    geno = sg.read_genotypes(spark, f"{tmp_path}/x.ldat")
    want = [("s1", "l1", "A", "G"), ("s1", "l2", "T", "T"), ("s2", "l1", None, None), ("s2", "l2", "A", "T")]
    assert rows(geno.select("sample", "locus", "a1", "a2"), "sample", "locus") == want
    sg.write_genotypes(geno, f"{tmp_path}/out", "tdat")
    assert rows(sg.read_triples(spark, f"{tmp_path}/out", format="tsv").select("sample", "locus", "a1", "a2"), "sample", "locus") == want
    (tmp_path / "p.ped").write_text("f i1 0 0 1 1 A G 0 0\n")
    (tmp_path / "p.map").write_text("1 l1 0 5\n1 l2 0 6\n")
    assert rows(sg.read_ped(spark, f"{tmp_path}/p.ped", f"{tmp_path}/p.map"), "locus") == [("i1", "l1", "A", "G"), ("i1", "l2", None, None)]
    (tmp_path / "e.geno").write_text("029\n")
    (tmp_path / "e.snp").write_text("l1 1 0 5 A C\n")
    (tmp_path / "e.ind").write_text("i1 M x\ni2 F x\ni3 F x\n")
    e = sg.read_eigenstrat(spark, f"{tmp_path}/e.geno", f"{tmp_path}/e.snp", f"{tmp_path}/e.ind")
    assert rows(e, "sample") == [("i1", "l1", "C", "C"), ("i2", "l1", "A", "A"), ("i3", "l1", None, None)]
    src.write_table(spark.createDataFrame([("1", "x")], "a string, b string"), f"{tmp_path}/d.db", table="t")
    assert rows(src.read_table(spark, f"{tmp_path}/d.db:table=t")) == [("1", "x")]


def test_fasta_and_bed(spark, tmp_path):
    (tmp_path / "f.fa").write_text(">a x\nAC\nGT\n>b\nTT\n")
    assert rows(sg.read_fasta(spark, f"{tmp_path}/f.fa"), "name") == [("a", "ACGT"), ("b", "TT")]
    (tmp_path / "r.bed").write_text("track x\nc1\t9\t5\tn\n")
    assert rows(sg.read_bed(spark, f"{tmp_path}/r.bed", 2)) == [("c1", 3, 11, "n")]


def test_normal():
    assert abs(st.normal_ppf(0.975) - 1.959963984540054) < 1e-9 and math.isclose(st.normal_sf2(1.959963984540054), 0.05, rel_tol=1e-9)


def test_transform_spec_takes_all_even_samples(spark, tmp_path):
    rows = [(s, s % 40, s, line, flag) for s in (2, 1998, 2000, 2041, 2042, 60_002, 60_003) for line, flag in ((1, "A"), (2, "A"), (3, "R"))]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem"))
    (next((tmp_path / "lineitem").glob("*.parquet"))).rename(tmp_path / "lineitem.parquet")
    assert compare(spark, str(tmp_path), "transform_spec", catalog.QUERIES["transform_spec"], catalog.ORACLE_SQL["transform_spec"]) == 4


def test_distinct_without_order_compares_by_value(spark):
    t = spark.createDataFrame([("1",), ("1.0",), ("b",), ("b",)], "x string")
    assert tb.uniq_table(t, "x").count() == 2


def test_runs_over_many_ranges(spark):
    keys = [k // 7 % 3 for k in range(500)]
    t = spark.createDataFrame([(k, str(v)) for k, v in enumerate(keys)], "o long, x string").repartition(5)
    want = [k for k in range(500) if not k or keys[k] != keys[k - 1]]
    assert [r["o"] for r in tb.uniq_table(t, "x", ["o"], consecutive=True).orderBy("o").collect()] == want


def test_query_leaves_other_views_alone(spark):
    spark.range(3).createOrReplaceTempView("data")
    t = spark.createDataFrame([(7,)], "x long")
    a, b = tb.query(t, "SELECT x FROM data"), tb.query(spark.range(5).toDF("x"), "WITH y AS (SELECT x + 1 AS x FROM data) SELECT * FROM y")
    assert rows(a) == [(7,)] and b.count() == 5 and spark.table("data").count() == 3


def test_covariate_products_are_not_the_locus(spark):
    rng = np.random.default_rng(1)
    n = 200
    age, sex, x = rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 3, n)
    y = 3 * age * sex + rng.normal(size=n)
    data = spark.createDataFrame([("l", float(a), float(b), float(c), float(a * b), float(d)) for a, b, c, d in zip(age, sex, x, y)], "locus string, age double, sex double, x double, both double, y double")
    ps = [rg.scan(data, f).where("term = 'trend'").first()["wald_p"] for f in ("y = TREND(locus) + age*sex", "y = TREND(locus) + both")]
    assert math.isclose(*ps, rel_tol=1e-9) and ps[0] > 0.01


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.binomial(2, 0.1, (10, 60)), rng.binomial(2, 0.8, (10, 60))))
    x[3, 5] = -1  # not called
    data = spark.createDataFrame([(f"s{i:02d}", j, int(v)) for (i, j), v in np.ndenumerate(x) if v >= 0], "sample string, locus int, x int")
    got = pr.principal_components(data, 1)
    total = np.zeros((20, 20))
    for j in range(60):
        on = x[:, j] >= 0
        share = (x[on, j].sum() / 2 + 0.5) / (on.sum() + 1)
        z = np.where(on, x[:, j] / 2 - x[on, j].mean() / 2, 0) / np.sqrt(share * (1 - share))
        total += np.outer(z, z)
    want = np.linalg.eigh(total)[1][:, -1]
    assert np.allclose(np.abs(got["pc1"].to_numpy()), np.abs(want), atol=1e-8)
    assert len({tuple(np.sign(got["pc1"].to_numpy()[k : k + 10])) for k in (0, 10)}) == 2


def test_overlaps_of_very_different_lengths(spark):
    from strataloom.operators import intervals as iv

    rng = np.random.default_rng(5)
    make = lambda n: [(int(s), int(s + rng.choice([0, 1, 3, 60, 64, 65, 700, 5000, 10**8]))) for s in rng.integers(0, 20_000, n)]
    a, b = make(60), make(60)
    frame = lambda xs: spark.createDataFrame([("c", s, e, k) for k, (s, e) in enumerate(xs)], "chrom string, start long, end long, name long")
    got = sorted((r["name"], r["name_b"], r["overlap"]) for r in iv.overlap_join(frame(a), frame(b)).collect())
    assert got == sorted((i, j, min(e, f) - max(s, u)) for i, (s, e) in enumerate(a) for j, (u, f) in enumerate(b) if s < f and u < e and s < e and u < f)
    points = spark.createDataFrame([("c", int(p)) for p in range(0, 21_000, 700)], "chrom string, pos long")
    held = sorted((r["pos"], r["name"]) for r in iv.point_join(points, frame(b)).collect())
    assert held == sorted((p, j) for p in range(0, 21_000, 700) for j, (u, f) in enumerate(b) if u <= p < f)
    assert iv._bins(frame([(0, 10**9)]), 64, [0]).count() <= 2

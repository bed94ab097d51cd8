import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.functions import intensity as it
from strataloom.functions import sequences as sq
from strataloom.operators import composition as cp
from strataloom.operators import genotypes as g
from strataloom.operators import loci as lo
from strataloom.operators import pedigrees as pd
from strataloom.sources import genotypes as sg
from strataloom.sources import plink as pl

CELLS = "sample string, locus string, a1 string, a2 string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def genotypes(spark):
    r, data = random.Random(2), []
    for s, x in itertools.product(range(13), range(9)):
        a, b = ("A", "C") if x % 2 else ("G", "T")
        kind = r.randrange(5)
        if kind < 4:
            data.append((f"s{s:02d}", f"l{x}", *[(a, a), (a, b), (b, b), (None, None)][kind]))
    return spark.createDataFrame(data, CELLS)


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(f"l{x}", str(1 + x // 5), 100 - x) for x in range(9)], "locus string, chrom string, location long")


def test_genotype_files_round_trip(spark, genotypes, places, tmp_path, monkeypatch):
    want, stem = rows(g.drop_missing(genotypes)), str(tmp_path / "new" / "x")
    pl.write_bed_matrix(genotypes, stem, places)
    for size in (pl.RANGE_BYTES, 8):  # one range, and one for each two rows
        monkeypatch.setattr(pl, "RANGE_BYTES", size)
        assert rows(g.drop_missing(pl.read_bed_matrix(spark, f"{stem}.bed"))) == want
    data = open(f"{stem}.bed", "rb").read()
    codes = pl.unpack(np.frombuffer(data[3:], np.uint8).reshape(9, -1), 13).T
    with open(f"{stem}-2.bed", "wb") as out:  # a row for each sample
        out.write(pl.MAGIC + bytes([pl.SAMPLE_MAJOR]) + b"".join(pl.pack(c) for c in codes))
    assert rows(g.drop_missing(pl.read_bed_matrix(spark, f"{stem}-2.bed", f"{stem}.bim", f"{stem}.fam"))) == want
    pl.write_tped(genotypes, stem, places)
    assert rows(g.drop_missing(sg.read_tped(spark, f"{stem}.tped", f"{stem}.tfam"))) == want
    pl.write_ped(genotypes, stem, places)
    assert rows(g.drop_missing(sg.read_ped(spark, f"{stem}.ped", f"{stem}.map"))) == want
    pl.write_vcf(genotypes, f"{stem}.vcf", places)
    assert rows(g.drop_missing(sg.read_genotypes(spark, f"{stem}.vcf"))) == want


def test_damaged_matrix_and_third_allele(spark, genotypes, tmp_path):
    stem = str(tmp_path / "x")
    pl.write_bed_matrix(genotypes, stem)
    whole = open(f"{stem}.bed", "rb").read()
    for damaged in (whole[:-1], b"xx" + whole[2:], b""):
        open(f"{stem}.bed", "wb").write(damaged)
        with pytest.raises(ValueError):
            pl.read_bed_matrix(spark, f"{stem}.bed")
    three = spark.createDataFrame([("s", "l", "A", "C"), ("t", "l", "G", "G")], CELLS)
    with pytest.raises(Exception, match="more than two alleles"):
        pl.write_bed_matrix(three, str(tmp_path / "y"))


def test_pedigree_goes_with_the_matrix(spark, genotypes, tmp_path):
    stem = str(tmp_path / "x")
    known = spark.createDataFrame([("s01", "f", "s02", None, "1", "2")], "name string, family string, parent1 string, parent2 string, sex string, pheno string")
    pl.write_bed_matrix(genotypes, stem, None, known)
    fam = {r["name"]: r for r in pl.read_fam(spark, f"{stem}.fam").collect()}
    assert tuple(fam["s01"])[1:] == ("f", "s01", "s02", None, "1", "2") and fam["s05"]["family"] == "s05"


def test_windows_against_slices(spark):
    r = random.Random(1)
    seqs = {n: "".join(r.choice("ACGTNacg") for _ in range(k)) for n, k in (("a", 533), ("b", 64), ("c", 1), ("d", 200))}
    df = spark.createDataFrame([*seqs.items(), ("empty", ""), ("none", None)], "name string, seq string")
    asked = [(n, p) for n, s in seqs.items() for p in range(0, len(s), 3)]
    places = spark.createDataFrame([*asked, ("a", 10**6), ("a", -1), ("zz", 1), ("empty", 0)], "name string, pos long")
    found = {(x["name"], x["pos"], x["window"]): (x["gc"], x["cpg"]) for x in cp.window_shares(cp.tiles(df, 64), places, [5, 50, 1000], 64).collect()}
    assert len(found) == 3 * len(asked)
    for (n, p), w in itertools.product(asked, (5, 50, 1000)):
        s = seqs[n].upper()
        low, high = max(0, p - w // 2), min(len(s), p + (w + 1) // 2)
        valid = sum(c in "ACGT" for c in s[low:high]) or 1
        pairs = sum(s[i - 1 : i + 1] == "CG" for i in range(max(low, 1), high))
        assert found[n, p, w] == pytest.approx((sum(c in "CG" for c in s[low:high]) / valid, 2 * pairs / valid))


def test_windows_broadcast_no_side(spark, tmp_path):
    """A small file whose rows are multiplied looks small to the optimizer."""
    spark.range(50).selectExpr("id AS name", "repeat('ACGT', 16) AS seq").write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    places = df.select("name", F.explode(F.sequence(F.lit(0), F.lit(56), F.lit(8))).alias("pos"))
    plan = cp.window_shares(cp.tiles(df, 16), places, [5, 20], 16)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_strands(spark):
    cases = {
        "TTGA[g/a]CCAT": ("Top", "A", "G"), "ACC[C/T]G": ("Bot", "T", "C"), "GG[A/T]CC": ("Unknown", "A", "T"), "GCA[A/T]TGC": ("Unknown", "A", "T"),
        "CCA[C/G]GTT": ("Top", "C", "G"), "CCG[C-G]TTT": ("Bot", "G", "C"), "[A/T]": ("Unknown", "A", "T"), "no snp": (None, None, None), None: (None, None, None),
    }
    found = spark.createDataFrame([(c,) for c in cases], "s string").select("s", sq.snp_strand(F.col("s")).alias("r")).collect()
    assert {x["s"]: tuple(x["r"]) for x in found} == cases
    pairs = spark.createDataFrame([("G", "A"), ("T", "C"), ("G", "C"), ("A", "A")], "a string, b string")
    assert [x[0] for x in pairs.select(sq.strand_of_pair(F.col("a"), F.col("b"))).collect()] == ["Top", "Bot", "Unknown", "Unknown"]


def test_strands_take_a_text_apart_once(spark):
    plan = spark.range(3).select(sq.snp_strand(F.col("id").cast("string")).alias("r")).select("r.*")._jdf.queryExecution().optimizedPlan().toString()
    assert 4 <= plan.count("regexp_extract") <= 12  # four for each field at most


def test_locus_filters(spark, places):
    assert lo.ranges("5-2, -7,8-,-") == [(2, 5), (None, 7), (8, None), (None, None)]
    with pytest.raises(ValueError):
        lo.ranges("1-2-3")
    assert sorted(r["location"] for r in lo.by_range(places, "93-95,99-").collect()) == [93, 94, 99, 100]
    near = lo.near_monitored(places, spark.createDataFrame([("l0",), ("l8",), ("l8",), ("x",)], "n string"), 2)
    assert sorted(r["locus"] for r in near.collect()) == ["l0", "l1", "l2", "l6", "l7", "l8"]


def test_allele_maps(spark):
    cells = lambda pairs: spark.createDataFrame([(f"s{i}", "l", *p) for i, p in enumerate(pairs)], CELLS)
    left = cells(["AA", "AA", "AG", "GG", "GG", "GG", "AG"])
    right = cells(["TT", "TT", "CT", "CC", "CC", "CC", "TT"])
    assert lo.remap_alleles(left, right).collect()[0].asDict() == {"locus": "l", "concord": 6, "ident": 0, "allele_map": {"T": "A", "C": "G"}, "category": "complement"}
    assert lo.remap_alleles(left, left).select("concord", "ident", "category").collect() == [(7, 2, "identity")]
    more = lo.remap_alleles(cells(["AA", "AA"]), cells(["CC", "CT"])).collect()[0]  # the right side has more alleles
    assert (more["concord"], more["allele_map"]) == (1, {"C": "A"})
    kinds = [({"A": "A", "G": "C"}, "partial complement"), ({"A": "G", "G": "A"}, "swap"), ({"A": "G", "G": "A", "T": "T"}, "partial swap"), ({"A": "C", "C": "G"}, "other")]
    maps = spark.createDataFrame([(m, k) for m, k in kinds], "m map<string,string>, k string")
    assert maps.where(lo.remap_category(F.col("m")) != F.col("k")).count() == 0


def test_two_sets_by_locus(spark):
    left = spark.createDataFrame([("s1", "l", "A", "A"), ("s2", "l", "A", "C"), ("s3", "l", "C", "C"), ("s4", "l", None, None), ("s1", "only", "A", "A")], CELLS)
    right = spark.createDataFrame([("s1", "l", "A", "A"), ("s2", "l", "A", "C"), ("s3", "l", "A", "C"), ("s5", "l", "C", "C")], CELLS)
    found = lo.genotype_correlation(left, right).collect()
    assert len(found) == 1 and found[0]["samples"] == 5 and found[0]["comps"] == 3
    assert found[0]["concordance"] == pytest.approx(2 / 3) and found[0]["missing1"] == pytest.approx(0.4)
    assert found[0]["r2_trend"] == pytest.approx(np.corrcoef([0, 1, 2], [0, 1, 1])[0, 1] ** 2)


def _brute(families, called, alleles):
    """Genotypes that some choice for a whole family contains, over and over, from all choices."""
    everything = [(a, b) for a in alleles for b in alleles if a <= b]
    left = {m: {called[m]} if m in called else set(everything) for p, q, cs in families for m in (p, q, *cs)}
    while True:
        new = {m: set(s) for m, s in left.items()}
        for p, q, cs in families:
            members = [p, q, *cs]
            if all(m in called for m in members):
                continue
            fine = []
            for choice in itertools.product(*[sorted(new[m]) for m in members]):
                x, y = choice[:2]
                if all(tuple(sorted(c)) in {tuple(sorted((i, j))) for i in x for j in y} for c in choice[2:]):
                    fine.append(choice)
            new.update({m: {c[k] for c in fine} for k, m in enumerate(members)})
        if new == left:
            return left
        left = new


def test_elimination_against_all_choices(spark):
    r = random.Random(5)
    people = {"c1": ("m", "f"), "c2": ("m", "f"), "g1": ("c1", "w"), "g2": ("c1", "w"), "z": ("x", "y")}
    everybody = sorted({*people, *(p for ps in people.values() for p in ps)})
    pedigree = spark.createDataFrame([(n, *ps) for n, ps in people.items()] + [("m", None, None)], "name string, parent1 string, parent2 string")
    families = {}
    for n, ps in people.items():
        families.setdefault(tuple(sorted(ps)), []).append(n)
    data, known = [], {}
    for x in range(25):
        alleles = "ACG"[: 2 + x % 2]
        known[f"l{x}"] = {p: tuple(sorted(r.choices(alleles, k=2))) for p in everybody if r.random() < 0.6}
        data += [(p, f"l{x}", *gt) for p, gt in known[f"l{x}"].items()] + [(p, f"l{x}", None, None) for p in everybody if p not in known[f"l{x}"]]
    found = pd.genotype_elimination(spark.createDataFrame(data, CELLS), pedigree).collect()
    got = {(row["locus"], row["sample"]): list(row["possible"]) for row in found}
    for x, called in known.items():
        for part in ([k for k in families if k != ("x", "y")], [("x", "y")]):
            fs = [(*k, sorted(families[k])) for k in part]
            members = {m for p, q, cs in fs for m in (p, q, *cs)}
            if not members & set(called):
                assert not any((x, m) in got for m in members)
                continue
            want = _brute(fs, called, sorted({a for gt in called.values() for a in gt}))
            assert {m: got[x, m] for m in members} == {m: ["/".join(p) for p in sorted(s)] for m, s in want.items()}


def test_family_errors_need_whole_families(spark):
    pedigree = spark.createDataFrame([("c", "p", "q"), ("d", "p", "q"), ("e", "r", "s"), ("h", "r", None)], "name string, parent1 string, parent2 string")
    cell = lambda locus, **who: [(n, locus, *v) for n, v in who.items()]
    data = cell("1", p="AA", q="CC", c="AA", d="AC") + cell("2", p="AA", q="AC", c="CC", d="AA") + cell("3", p="AC", q="AA", c="AA") + cell("4", r="AC", s="AC", e="AC") + cell("5", r="AC", s="AG", e="CC")
    data += cell("6", r="AC", s="GG", e="AC") + cell("7", r="AG", s="AC", e="GG") + cell("8", r="AC", s="AC", e="GG") + cell("9", r="AG", s="AT", e="AG")
    data += cell("10", r="AC", s="CC", e="AA") + cell("11", r="AA", s="AC", e="CC") + cell("12", r="AC", s="AG", e="AT")
    found = {(row["locus"], row["child"]): row["level"] for row in pd.family_errors(spark.createDataFrame(data, CELLS), pedigree).collect()}
    assert found == {("1", "c"): 1, ("2", "c"): 1, ("5", "e"): 1, ("6", "e"): 1, ("7", "e"): 1, ("8", "e"): 1, ("10", "e"): 1, ("11", "e"): 1, ("12", "e"): 2}


def test_intensities(spark):
    nan = float("nan")
    df = spark.createDataFrame([("g", float(i * i % 17), float(i * 3 % 11)) for i in range(20)] + [("g", nan, 1.0), ("h", 3.0, None)], "k string, x double, y double")
    done = it.quantile_normalize(df, "k", "x", "y").collect()
    good = [r for r in done if r["k"] == "g" and r["x"] == r["x"]]
    assert len(done) == 22 and sorted(r["x"] for r in good) == sorted(r["y"] for r in good)
    xs, ys = sorted(i * i % 17 for i in range(20)), sorted(i * 3 % 11 for i in range(20))
    assert sorted(r["x"] for r in good) == [(a + b) / 2 for a, b in zip(xs, ys)]
    means = dict(it.trimmed_mean(df, "k", "x", 0.1).collect())
    assert means["g"] == pytest.approx(np.mean(xs[2:-2])) and means["h"] == 3.0
    centres = it.cluster_centres(spark.createDataFrame([("l", "AA", 1.0, 0.1), ("l", "BB", 2.0, 0.9), ("l", "BB", nan, 0.5)], "locus string, g string, r double, theta double"))
    assert centres.collect()[0].asDict() == {"locus": "l", "t_aa": 0.1, "r_aa": 1.0, "t_ab": 0.5, "r_ab": 1.5, "t_bb": 0.9, "r_bb": 2.0}
    c = {k: F.lit(v) for k, v in {"t_aa": 0.1, "r_aa": 1.0, "t_ab": 0.5, "r_ab": 1.5, "t_bb": 0.9, "r_bb": 2.0}.items()}
    points = spark.createDataFrame([(1.0, 0.05), (1.25, 0.3), (1.5, 0.5), (3.5, 0.7), (2.0, 1.0), (1.0, None)], "r double, t double")
    lrr, baf = it.log_ratio(F.col("r"), F.col("t"), c)
    found = points.select(F.round(lrr, 4), F.round(baf, 4)).collect()
    want = [(0, 0), (0, 0.25), (0, 0.5), (1, 0.75), (0, 1)]
    assert tuple(found.pop()) == (None, None)
    assert [tuple(x) for x in found] == [pytest.approx(w, abs=1e-4) for w in want]


@pytest.mark.parametrize("share", [0.0, 0.07, 0.5])
def test_trimmed_means_in_ranges(spark, share):
    r = random.Random(8)
    data = [(r.choice(["a", "a", "b", None]), float(r.choice([r.randrange(5), r.randrange(1000)]))) for _ in range(600)] + [("c", 2.0)]
    found = it.trimmed_mean(spark.createDataFrame([*data, ("a", float("nan")), ("b", None)], "k string, x double"), "k", "x", share)
    want = {}
    for k in ("a", "b", "c", None):
        xs = sorted(x for g, x in data if g == k)
        cut = int(len(xs) * share)
        if xs[cut : len(xs) - cut]:
            want[k] = pytest.approx(np.mean(xs[cut : len(xs) - cut]))
    assert dict(map(tuple, found.collect())) == want
    windows = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    assert windows and not any("row_number" in line for line in windows)  # no task orders a whole group's rows

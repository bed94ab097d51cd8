import pathlib

import pytest

from strataloom.operators import genotypes as g
from strataloom.sources import exchange as ex
from strataloom.sources import genotypes as sg

CELLS = "sample string, locus string, a1 string, a2 string"


@pytest.fixture(scope="module")
def data(spark):
    rows = [("f1:x", "m1", "A", "A"), ("f1:x", "m2", "C", "T"), ("f1:y", "m1", "A", "G"), ("f1:y", "m2", None, None), ("f2:x", "m1", "G", "G"), ("f2:x", "m2", "C", "C"), ("f2:x", "m3", "T", "T")]
    loci = spark.createDataFrame([("m1", "1", 30), ("m2", "1", 20), ("m3", "2", 5)], "locus string, chrom string, location long")
    return spark.createDataFrame(rows, CELLS), loci


def called(df):
    return sorted(tuple(r) for r in g.drop_missing(df).collect())


def lines(path):
    """All parts of a folder in the order of their names."""
    return [line for part in sorted(pathlib.Path(path).glob("part-*")) for line in part.read_text().splitlines()]


def test_round_trips(spark, data, tmp_path):
    df, loci = data
    want, at = called(df), str(tmp_path)
    samples = ex.write_probabilities(df, f"{at}/p", loci)
    assert samples == ["f1:x", "f1:y", "f2:x"] and called(ex.read_probabilities(spark, f"{at}/p", samples)) == want
    with pytest.raises(ValueError):
        ex.read_probabilities(spark, f"{at}/p", samples, 0.4)
    ex.write_dosage_table(df, f"{at}/d", loci)
    assert called(ex.read_dosage_table(spark, f"{at}/d")) == want
    ex.write_eigenstrat(df, f"{at}/e", loci)
    assert called(sg.read_eigenstrat(spark, f"{at}/e.geno", f"{at}/e.snp", f"{at}/e.ind")) == want
    ex.write_linkage(df, f"{at}/l", loci)
    assert called(ex.read_linkage(spark, f"{at}/l.ped", f"{at}/l.dat")) == want


def test_thresholds_and_dosages(spark, tmp_path):
    path = str(tmp_path / "p")
    with open(path, "w") as out:
        out.write("1 m 7 A C 0.95 0.05 0 0 0.96 0.04 0 0 0\n")
    assert called(ex.read_probabilities(spark, path, ["r", "s", "t"])) == [("s", "m", "A", "C")]
    assert called(ex.read_probabilities(spark, path, ["r", "s", "t"], 0.5)) == [("r", "m", "A", "A"), ("s", "m", "A", "C")]
    assert {r["sample"]: r["x"] for r in ex.read_probability_dosages(spark, path, ["r", "s", "t"]).collect()} == {"r": 0.05, "s": pytest.approx(1.04), "t": None}
    table = str(tmp_path / "d")
    with open(table, "w") as out:
        out.write("SNP\tChromosome\tPosition\tAlleleA\tAlleleB\tr\ts\tt\nm\t1\t7\tA\tC\t0.2\t1.6\t-1\n")
    assert called(ex.read_dosage_table(spark, table)) == [("r", "m", "A", "A"), ("s", "m", "C", "C")]


def test_linkage_forms(spark, tmp_path):
    with open(tmp_path / "a.ped", "w") as out:
        out.write("1 2 0 0 1 A/C 0/0\n1 3 0 0 2 x x G T\n")
    with open(tmp_path / "a.dat", "w") as out:
        out.write("# markers\nM m1\nM m2\n")
    assert called(ex.read_linkage(spark, str(tmp_path / "a.ped"), str(tmp_path / "a.dat"))) == [("1:2", "m1", "A", "C"), ("1:3", "m2", "G", "T")]
    with open(tmp_path / "b.dat", "w") as out:
        out.write("T trait\n")
    with pytest.raises(ValueError):
        ex.read_linkage(spark, str(tmp_path / "a.ped"), str(tmp_path / "b.dat"))


def test_sample_texts(spark, data, tmp_path):
    df, loci = data
    ex.write_structure(df, str(tmp_path / "s"), loci)
    assert lines(str(tmp_path / "s")) == ["m2 m1 m3", "f1:x 1 1 -9", "f1:x 2 1 -9", "f1:y -9 1 -9", "f1:y -9 2 -9", "f2:x 1 2 1", "f2:x 1 2 1"]
    ex.write_phase(df, str(tmp_path / "h"), loci)
    assert lines(str(tmp_path / "h")) == ["3", "3", "P 20 30 5", "SSS", "#f1:x", "C A ?", "T A ?", "#f1:y", "? A ?", "? G ?", "#f2:x", "C G T", "C G T"]


def test_conversion_and_contents(spark, data, tmp_path):
    df, _ = data
    df.write.parquet(str(tmp_path / "a.parquet"))
    spark.createDataFrame([("f1:x", "m1", "A", "A"), ("f1:y", "m1", "G", "G"), ("new", "m1", "A", None)], CELLS).write.parquet(str(tmp_path / "b.parquet"))
    ex.convert(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")], str(tmp_path / "c.parquet"), "parquet")
    merged = spark.read.parquet(str(tmp_path / "c.parquet"))
    assert ("f1:x", "m1", "A", "A") in called(merged) and not any(r[:2] == ("f1:y", "m1") for r in called(merged))
    assert ex.contents(merged).collect()[0].asDict() == {"samples": 4, "loci": 3, "cells": 8, "called": 5, "half_called": 1, "monomorphic": 1, "biallelic": 2, "multiallelic": 0}


def test_many_names_stay_out_of_the_plan(spark, tmp_path):
    names = [f"s{k}" for k in range(3000)]
    (tmp_path / "p").write_text(" ".join(["1", "m", "7", "A", "C", *["0 1 0"] * 3000]) + "\n")
    found = ex.read_probabilities(spark, str(tmp_path / "p"), names)
    assert "s2999" not in found._jdf.queryExecution().analyzed().toString() and "[s0" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "array(s0" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, found.collect())) == sorted((n, "m", "A", "C") for n in names)

import itertools
import random

import pytest

from strataloom.operators import intervals as iv
from strataloom.operators import pairs as pr


@pytest.fixture(scope="module")
def some():
    r = random.Random(6)
    out = []
    for chrom, n in (("1", 60), ("2", 25), (None, 4)):
        for _ in range(n):
            start = r.randrange(400)
            out.append((chrom, start, start + r.choice([1, 3, 9, 9, 150]) * (r.random() < 0.95)))
    return out + [("3", 7, 9)]


@pytest.mark.parametrize("tile", [8, 64, iv.TILE])
def test_sweeps_in_tiles(spark, some, tile):
    df = spark.createDataFrame(some, "chrom string, start long, end long")
    for chrom in ("1", "2", "3", None):
        own = sorted(x[1:] for x in some if x[0] == chrom)
        height = [sum(s <= p < e for s, e in own) for p in range(600)]
        cuts = [p for p in range(600) if p == 0 or height[p] != height[p - 1]]
        want = [(a, b, height[a]) for a, b in zip(cuts, [*cuts[1:], 600]) if height[a]]
        here = df.where("chrom IS NULL") if chrom is None else df.where(df.chrom == chrom)
        assert sorted(tuple(r)[1:] for r in iv.depth(here, tile).collect()) == want
    merged = []
    for chrom, start, end in sorted(some, key=lambda x: (x[0] or "", x[1], x[2])):
        if merged and merged[-1][0] == chrom and start <= merged[-1][2]:
            merged[-1] = (chrom, merged[-1][1], max(end, merged[-1][2]), merged[-1][3] + 1)
        else:
            merged.append((chrom, start, end, 1))
    found = [tuple(r) for r in iv.islands(df, tile=tile).select("chrom", "start", "end", "n").collect()]
    assert sorted(found, key=str) == sorted(merged, key=str)


@pytest.mark.parametrize("tile", [8, iv.TILE])
def test_nearest_over_tiles(spark, some, tile):
    df = spark.createDataFrame(some, "chrom string, start long, end long")
    places = [(c, p) for c in ("1", "2", "4") for p in range(0, 620, 31)]
    found = iv.nearest(spark.createDataFrame(places, "chrom string, pos long"), df, 3, tile=tile).collect()
    got = {(r["chrom"], r["pos"], r["rank"]): r["distance"] for r in found}
    want = {}
    for c, p in places:
        ends = sorted((e for x, _, e in some if x == c and e <= p), reverse=True)
        want.update({(c, p, k + 1): p - e for k, e in enumerate(ends[:3])})
    assert got == want


def test_packed_counts_against_single_samples(spark):
    r = random.Random(9)
    x = {(s, k): r.choice([0, 0, 1, 2, None]) for s in range(150) for k in "abc"}
    dosages = spark.createDataFrame([(s, k, v) for (s, k), v in x.items()], "sample long, locus string, x int")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "b")], "locus1 string, locus2 string")
    for row in pr.haplotype_counts(dosages, pairs).collect():
        n = {(i, j): sum(x[s, row["locus1"]] == i and x[s, row["locus2"]] == j for s in range(150)) for i, j in itertools.product(range(3), repeat=2)}
        assert row["dh"] == n[1, 1] and row["c11"] == 2 * n[0, 0] + n[0, 1] + n[1, 0] and row["c12"] == 2 * n[0, 2] + n[0, 1] + n[1, 2]
        assert row["c21"] == 2 * n[2, 0] + n[2, 1] + n[1, 0] and row["c22"] == 2 * n[2, 2] + n[2, 1] + n[1, 2]

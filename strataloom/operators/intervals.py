"""Half-open intervals (chrom, start, end): overlap joins, depth, islands, nearest neighbours and coverage.

Overlaps meet in bins of several levels, by the length of intervals: bins join by equality, and a pair counts in
the one bin where its overlap begins. Sweeps run in tiles of a chromosome, each with what the tiles before it carry over: a
table of one row a tile, so that one chromosome spreads over many tasks and results are those of one sweep.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Default width of a bin of the first level: near the median interval length. Each level's bins are ``STEP`` times as wide as those of the one before.
WIDTH, STEP, LEVELS = 64, 8, 12

#: Default width of a sweep's tile.
TILE = 1 << 20


def _level(width: int) -> Column:
    """The first level whose bins are no shorter than the interval, which so touches two at most."""
    length = F.col("end") - F.col("start")
    return sum((F.when(length > width * STEP**k, 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0))


def _levels(df: DataFrame, width: int) -> list[int]:
    """The levels in use, at most ``LEVELS``."""
    return sorted(r[0] for r in df.where("end > start").select(_level(width)).distinct().collect())


def _bin(pos: Column, width: int) -> Column:
    widths = F.array(*[F.lit(width * STEP**k).cast("long") for k in range(LEVELS)])
    return F.floor(pos / F.element_at(widths, F.col("level") + 1)).cast("long")


def _bins(df: DataFrame, width: int, others: list[int]) -> DataFrame:
    """An interval stands in the bins of its own level and of the longer levels of the other side. Empty intervals overlap nothing and get no bin."""
    own = df.where("end > start").withColumn("own_level", _level(width))
    longer = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("own_level"))
    at = own.withColumn("level", F.explode(F.concat(F.array("own_level"), longer)))
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return at.withColumn("bin", F.explode(F.sequence(_bin(F.col("start"), width), _bin(last, width))))


def overlap_join(a: DataFrame, b: DataFrame, width: int = WIDTH, suffix: str = "_b") -> DataFrame:
    """All pairs with a.start < b.end and b.start < a.end, with the bases that overlap. Columns of ``b`` get a suffix.

    A pair meets at the level of its longer interval, so an interval of any length stands in few bins.
    """
    right = _bins(b, width, _levels(a, width))
    right = right.toDF(*[c if c in ("chrom", "bin", "level") else f"{c}{suffix}" for c in right.columns])
    s, e = F.col(f"start{suffix}"), F.col(f"end{suffix}")
    joined = _bins(a, width, _levels(b, width)).join(right, ["chrom", "level", "bin"]).where((F.col("start") < e) & (s < F.col("end")))
    begin = F.greatest("start", s)
    once = (F.col("level") == F.greatest("own_level", f"own_level{suffix}")) & (F.col("bin") == _bin(begin, width))
    return joined.where(once).withColumn("overlap", F.least(F.col("end"), e) - begin).drop("bin", "level", "own_level", f"own_level{suffix}")


def point_join(points: DataFrame, intervals: DataFrame, width: int = WIDTH) -> DataFrame:
    """Points (chrom, pos) with the intervals that hold them."""
    levels = F.array(*map(F.lit, _levels(intervals, width))).cast("array<int>")
    at = points.withColumn("level", F.explode(levels)).withColumn("bin", _bin(F.col("pos"), width))
    return at.join(_bins(intervals, width, []), ["chrom", "level", "bin"]).where("start <= pos AND pos < end").drop("bin", "level", "own_level")


def best_overlap(a: DataFrame, b: DataFrame, key: str, name: str, least: int = 1, fraction: float = 0.0, width: int = WIDTH) -> DataFrame:
    """For each key of ``a`` the target ``name`` of ``b`` with the largest share of the interval covered."""
    pairs = overlap_join(a, b, width).withColumn("share", F.col("overlap") / (F.col("end") - F.col("start")))
    kept = pairs.where((F.col("overlap") >= least) & (F.col("share") >= fraction))
    best = kept.groupBy(key).agg(F.min(F.struct((-F.col("share")).alias("share"), F.col(f"{name}_b").alias("name"))).alias("best"))
    return best.select(key, F.col("best.name").alias(name), (-F.col("best.share")).alias("share"))


def _tiled(rows: DataFrame, at: str, tile: int, sums: dict[str, Column], carried: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Rows with their ``tile`` and what each takes from the others: windows over the chromosome's tiles, of which ``sums`` gives one row each."""
    placed = rows.withColumn("tile", F.floor(F.col(at) / tile))
    by_tile = Window.partitionBy("chrom").orderBy("tile")
    small = placed.groupBy("chrom", "tile").agg(*[c.alias(n) for n, c in sums.items()])
    small = small.select(F.col("chrom").alias("__chrom"), F.col("tile").alias("__tile"), *[f(by_tile).alias(n) for n, f in carried.items()])
    return placed.join(small, F.col("chrom").eqNullSafe(F.col("__chrom")) & F.col("tile").eqNullSafe(F.col("__tile"))).drop("__chrom", "__tile")


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _changes(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, d): by how much the depth changes at a place."""
    ends = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("d")))
    steps = df.where("end > start").select(*keys, F.explode(ends).alias("e"))
    return steps.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d <> 0")


def depth(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Maximal segments (chrom, start, end, depth) of constant depth above 0, by a sweep over interval ends."""
    sums = {"d_sum": F.sum("d"), "first": F.min("pos")}
    carried = {"d_before": lambda w: F.coalesce(F.sum("d_sum").over(_before(w)), F.lit(0)), "pos_after": lambda w: F.lead("first").over(w)}
    placed = _tiled(_changes(df, "chrom"), "pos", tile, sums, carried)
    w = Window.partitionBy("chrom", "tile").orderBy("pos")
    run = F.col("d_before") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    end = F.coalesce(F.lead("pos").over(w), F.col("pos_after"))
    return placed.select("chrom", F.col("pos").alias("start"), end.alias("end"), run.alias("depth")).where("depth > 0 AND end IS NOT NULL")


def tiled_depth(df: DataFrame, tile: int = TILE) -> DataFrame:
    """As ``depth``, with intervals cut at tile borders first: each (chrom, tile) is swept apart, nothing is carried over, and segments end at borders."""
    cut = df.where("end > start").withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    cut = cut.select("chrom", "tile", F.greatest("start", F.col("tile") * tile).alias("start"), F.least("end", (F.col("tile") + 1) * tile).alias("end"))
    w = Window.partitionBy("chrom", "tile").orderBy("pos")
    run = F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    swept = _changes(cut, "chrom", "tile").select("chrom", F.col("pos").alias("start"), F.lead("pos").over(w).alias("end"), run.alias("depth"))
    return swept.where("depth > 0 AND end IS NOT NULL")


def depth_histogram(segments: DataFrame, width: int = 1, most: int = 1000) -> DataFrame:
    """Bases at each depth bin, and at that depth or more."""
    bins = F.least((F.col("depth") / width).cast("bigint"), F.lit(most))
    h = segments.groupBy(bins.alias("bin")).agg(F.sum(F.col("end") - F.col("start")).alias("bases"))
    return h.withColumn("at_least", F.sum("bases").over(Window.orderBy(F.desc("bin"))))  # one row for each bin


def islands(df: DataFrame, name: str | None = None, pad: int = 0, tile: int = TILE) -> DataFrame:
    """Overlapping and touching intervals merged; swapped ends are put right; names are joined, sorted and distinct.

    Whether an interval begins an island follows from the ends before it, in its tile and, by their greatest one, in earlier tiles; islands are numbered likewise.
    """
    lo, hi = F.least("start", "end") - pad, F.greatest("start", "end") + pad
    fixed = df.withColumns({"start": F.greatest(lo, F.lit(0)), "end": hi})
    w = Window.partitionBy("chrom", "tile").orderBy("start", "end")
    placed = _tiled(fixed, "start", tile, {"most": F.max("end")}, {"reach": lambda t: F.max("most").over(_before(t))})
    before = F.greatest("reach", F.max("end").over(_before(w)))
    marked = placed.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).drop("tile", "reach")
    numbered = _tiled(marked, "start", tile, {"begun": F.sum("new")}, {"earlier": lambda t: F.coalesce(F.sum("begun").over(_before(t)), F.lit(0))})
    numbered = numbered.withColumn("island", F.col("earlier") + F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    extra = [F.array_join(F.array_sort(F.collect_set(name)), ",").alias(name)] if name else []
    return numbered.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), *extra)


def nearest(points: DataFrame, intervals: DataFrame, most: int = 1, max_distance: int | None = None, tile: int = TILE) -> DataFrame:
    """For each point (chrom, pos) the nearest intervals that end before it: rank and distance. One sweep over both, no pairs.

    Ends are numbered along the chromosome, tile by tile, and a point looks up the last ``most`` numbers before it.
    """
    both = points.select("chrom", F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("struct<end: bigint, start: bigint>").alias("iv"), "pos").unionByName(
        intervals.select("chrom", F.col("end").alias("at"), F.lit(0).alias("kind"), F.struct(F.col("end").cast("bigint").alias("end"), F.col("start").cast("bigint").alias("start")).alias("iv"), F.lit(None).cast("bigint").alias("pos"))
    )
    placed = _tiled(both, "at", tile, {"ends": F.sum(1 - F.col("kind"))}, {"earlier": lambda t: F.coalesce(F.sum("ends").over(_before(t)), F.lit(0))})
    w = Window.partitionBy("chrom", "tile").orderBy("at", "kind", "iv")
    rank = F.col("earlier") + F.sum(F.lit(1) - F.col("kind")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ranked = placed.withColumn("k", rank)
    ends = ranked.where("kind = 0").select("chrom", "k", "iv")
    wanted = ranked.where("kind = 1").select("chrom", "pos", "k", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("back"))
    found = wanted.withColumn("k", F.col("k") - F.col("back")).join(ends, ["chrom", "k"])
    out = found.select("chrom", "pos", (F.col("back") + 1).alias("rank"), "iv.start", "iv.end", (F.col("pos") - F.col("iv.end")).alias("distance"))
    return out.where(F.col("distance") <= max_distance) if max_distance is not None else out


def target_coverage(reads: DataFrame, targets: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """Bases of each target by depth, zero depth included."""
    segments = overlap_join(targets, tiled_depth(reads), width).groupBy(name, F.col("depth_b").alias("depth")).agg(F.sum("overlap").alias("bases"))
    covered = segments.groupBy(name).agg(F.sum("bases").alias("covered"))
    size = targets.select(name, (F.col("end") - F.col("start")).alias("size"))
    gaps = size.join(covered, name, "left").select(name, F.lit(0).cast("bigint").alias("depth"), (F.col("size") - F.coalesce("covered", F.lit(0))).alias("bases"))
    return segments.unionByName(gaps.where("bases > 0"))


def target_filter(reads: DataFrame, targets: DataFrame, key: str, least: int = 1, width: int = WIDTH) -> DataFrame:
    """Each read's class: on target if one overlap has at least ``least`` bases, else off target."""
    hits = overlap_join(reads, targets, width).groupBy(key).agg(F.max("overlap").alias("most"))
    on = F.coalesce(F.col("most") >= least, F.lit(False))
    return reads.join(hits, key, "left").withColumn("class", F.when(on, "ontarget").otherwise("offtarget")).drop("most")


def margin(strand: Column, start: Column, end: Column, up: int, down: int) -> tuple[Column, Column]:
    """Ends widened up- and downstream by strand."""
    back = strand == "-"
    return F.greatest(start - F.when(back, down).otherwise(up), F.lit(0)), end + F.when(back, up).otherwise(down)


def mark_duplicates(reads: DataFrame, keys: list[str], length: str, name: str) -> DataFrame:
    """All but the longest read of each start are duplicates; ties by name. The best is found by an aggregate, not a window."""
    best = reads.groupBy(*keys).agg(F.min(F.struct((-F.col(length)).alias("l"), F.col(name).alias("name"))).alias("best"))
    return reads.join(best, keys).withColumn("duplicate", F.col(name) != F.col("best.name")).drop("best")

"""Base composition of windows around places of long sequences that come in tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bases of a tile: a task holds one tile and at most two probes a base and window.
TILE = 1 << 16


def tiles(sequences: DataFrame, size: int = TILE) -> DataFrame:
    """(name, start, seq) of sequences (name, seq) in upper case, each tile ``size`` bases long but for the last one."""
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / size).cast("int")))
    cut = sequences.where(F.length("seq") > 0).select("name", "seq", at.alias("k"))
    return cut.select("name", (F.col("k") * size).cast("bigint").alias("start"), F.upper(F.substring("seq", F.col("k") * size + 1, F.lit(size))).alias("seq"))


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each probe: the counts up to it, with the probe's sign. The texts of a batch are counted as one."""
    for batch in batches:
        col = {k: batch.column(k) for k in batch.schema.names}
        text = pc.binary_join_element_wise(pc.coalesce(col["last"], pa.scalar("-")), col["seq"], "")
        if pc.any(pc.invert(pc.string_is_ascii(text))).as_py():  # a byte a base
            text = pc.replace_substring_regex(text, r"[^\x00-\x7f]", "-")
        size = pc.binary_length(text).to_numpy()
        at = np.cumsum(size) - size
        b = np.frombuffer("".join(text.to_pylist()).encode(), np.uint8)
        c, g = b == ord("C"), b == ord("G")
        kinds = {"valid": c | g | (b == ord("A")) | (b == ord("T")), "gc": c | g, "cpg": g & np.concatenate(([False], c[:-1]))}
        rows, probes = pc.list_parent_indices(col["probes"]).to_numpy(), pc.list_flatten(col["probes"])
        x, pos, window, sign = (a.to_numpy() for a in probes.flatten())
        first = at[rows]
        end = first + (x - col["start"].to_numpy()[rows])
        out = [col["name"].take(pa.array(rows)), pa.array(pos), pa.array(window)]
        for k, hit in kinds.items():
            upto = np.cumsum(hit)
            out.append(pa.array(sign * (upto[end] - upto[first] + col[f"{k}0"].to_numpy()[rows])))
        yield pa.RecordBatch.from_arrays(out, ["name", "pos", "window", *kinds])


def window_shares(tiled: DataFrame, places: DataFrame, windows: list[int], size: int = TILE) -> DataFrame:
    """(name, pos, window, gc, cpg): shares among the valid bases (A, C, G, T) of each window around each place (name, pos from 0).

    A window of w bases has w // 2 before its place and is cut at the ends of the sequence. A CpG pair counts at its G, twice a
    valid base; without valid bases shares are 0. Places outside their sequence or of unknown sequences are left out.

    Counts up to a probe are a running count of whole tiles, one row a tile, and a count within the probe's tile; so the cost does not depend on the windows'
    lengths, and sequences are never gathered. The joins are merged: none of their sides is small, though their estimates, which don't see that rows are
    multiplied, may be.
    """
    by_name = Window.partitionBy("name").orderBy("start")
    count = lambda pattern: F.regexp_count("seq", F.lit(pattern)).cast("bigint")
    last = F.lag(F.right("seq", F.lit(1))).over(by_name)
    joined = F.coalesce(((F.col("last") == "C") & F.startswith("seq", F.lit("G"))).cast("bigint"), F.lit(0))
    summed = tiled.select("name", "start", F.length("seq").alias("n"), count("[ACGT]").alias("valid"), count("[CG]").alias("gc"), count("CG").alias("cpg"), last.alias("last"), "seq")
    totals = summed.withColumn("cpg", F.col("cpg") + joined).drop("seq")
    earlier = by_name.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.partitionBy("name")).alias("total")
    heads = totals.select("name", "start", "last", total, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}0") for k in ("valid", "gc", "cpg")])
    tile = lambda x: (F.floor(x / size) * size).cast("bigint").alias("start")

    pos = F.col("pos").cast("bigint")
    placed = places.select("name", pos.alias("pos"), tile(pos)).join(heads.select("name", "start", "total").hint("merge"), ["name", "start"])
    placed = placed.where("pos >= 0 AND pos < total").select("name", "start", "pos", "total").distinct()
    asked = placed.select("name", "pos", "total", F.explode(F.array(*[F.lit(int(w)) for w in dict.fromkeys(windows)])).alias("window"))
    low = F.greatest(F.col("pos") - F.floor(F.col("window") / 2), F.lit(0))
    high = F.least(F.col("pos") + F.floor((F.col("window") + 1) / 2), F.col("total"))
    end = lambda x, sign: F.struct(x.cast("bigint").alias("x"), "pos", "window", F.lit(sign).cast("bigint").alias("sign"))
    probes = asked.select("name", F.explode(F.array(end(high, 1), end(low, -1))).alias("p")).where("p.x > 0")
    by_tile = probes.groupBy("name", tile(F.col("p.x") - 1)).agg(F.collect_list("p").alias("probes"))
    here = by_tile.join(heads.hint("merge"), ["name", "start"]).join(tiled.select("name", "start", "seq").hint("merge"), ["name", "start"])
    kind = tiled.schema["name"].dataType.simpleString()
    found = here.drop("total").mapInArrow(_local, f"name {kind}, pos bigint, window int, valid bigint, gc bigint, cpg bigint")
    within = found.groupBy("name", "pos", "window").agg(*[F.sum(k).alias(k) for k in ("valid", "gc", "cpg")])
    share = lambda n: F.coalesce(F.try_divide(n.cast("double"), F.col("valid").cast("double")), F.lit(0.0))
    return within.select("name", "pos", "window", share(F.col("gc")).alias("gc"), share(2 * F.col("cpg")).alias("cpg"))

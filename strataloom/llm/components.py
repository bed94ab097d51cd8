"""Connected components.

Up to ``ONE_TASK`` edges, counted first, are joined up by one task; beyond that, large-star and small-star steps alternate, each
written to the shared folder. Both give each node the least node of its component.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.text import map_arrow
from strataloom.plans.workspace import Workspace


#: Most edges, of 16 bytes each, that one task takes.
ONE_TASK = 1_000_000


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component: labels sink along edges and through one another until none moves."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b, label[a], label[b]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    import pyarrow as pa

    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, roots = least_labels(*(np.concatenate(x) for x in zip(*parts)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=schema)

    return map_arrow(edges.coalesce(1), run, "node long, root long")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("u", "v"), 12))).first())


def components(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node on an edge (u, v); the root is the component's least node."""
    current = work.table(edges.where("u <> v").select("u", "v"), f"{name}-0")
    if current.count() <= ONE_TASK:
        return work.table(_in_one_task(current), f"{name}-roots")
    step, mark = 0, _mark(current)
    while mark[0]:
        step += 1
        after = work.table(_small(_large(current).where("u <> v").distinct()).where("u <> v").distinct(), f"{name}-{step}")
        new = _mark(after)
        work.drop(f"{name}-{step - 1}")
        current, done, mark = after, new == mark, new
        if done:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select("v", "v").distinct())

"""Connected components by alternating large-star and small-star steps on DataFrames.

Nothing but (node, node) rows is shuffled, no neighbourhood is gathered in one place (minima are
pre-aggregated), and each round is cut by a checkpoint in the shared folder.  The number of rounds grows
with the logarithm of the longest chain.

Before the first round, each task reduces its own edges to stars of their least nodes, so what is shuffled
has at most one edge for each node of a task.  Once PART_EDGES edges or fewer are left, one task holds them
all, and the same reduction there is the result.

The rows of a node of many neighbours would meet in one task when they are joined with the node's least
neighbour.  At most 2 * SHARE nodes can have over 1 / SHARE of all edge ends: these few are broadcast to
wherever their rows lie, and only the other rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SHARE = 500
#: Edges of a partition at least: few edges are not spread over many tasks.
PART_EDGES = 100_000
#: Edges that a task holds before it reduces them.
HELD_EDGES = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a graph as (node, least node that it reaches by them), without least nodes themselves."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low != high
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(parent, high, low)
        while (parent[parent] != parent).any():
            parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def _reduced(edges: DataFrame) -> DataFrame:
    """Edges that join the same nodes: those of each partition as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = v = np.empty(0, np.int64)
        waiting, count = [], 0
        for batch in batches:
            waiting.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            count += batch.num_rows
            if count >= HELD_EDGES:
                u, v = stars(*(np.concatenate([x, *y]) for x, y in zip((u, v), zip(*waiting))))
                waiting, count = [], 0
                if len(u) >= HELD_EDGES:  # of too many nodes: the rounds join the rest
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                    u = v = np.empty(0, np.int64)
        if waiting:
            u, v = stars(*(np.concatenate([x, *y]) for x, y in zip((u, v), zip(*waiting))))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(run, "u long, v long")


def _with_least(rows: DataFrame, total: int, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(rows (u, v) for which keep holds, with the least v of their u as m; u and m of each u)."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    many = least.where(F.col("n") > max(16, total // SHARE)).select(F.col("u").alias("w"), F.col("m").alias("h"))
    marked = rows.join(F.broadcast(many), F.col("u") == F.col("w"), "left")
    few = marked.where("w IS NULL").where(keep).select("u", "v").join(least.select("u", "m"), "u")
    return marked.where("w IS NOT NULL").where(keep).select("u", "v", F.col("h").alias("m")).unionByName(few.select("u", "v", "m")), least.select("u", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    moved, _ = _with_least(both, total, F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    moved, least = _with_least(down, total, F.lit(True))
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (u, v) that join the same nodes: with no number of rounds, each node with the least that it can reach."""
    now = cut(_reduced(edges.where("u <> v")))
    count = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
    state = now.agg(*count).first()
    done = 0
    while state[0] and done != rounds:
        if state[0] <= PART_EDGES:
            return cut(_reduced(now.coalesce(1)))
        parts = -(-state[0] // PART_EDGES)
        now = cut(_small_star(_large_star(now.coalesce(parts), state[0]), state[0]).coalesce(parts))
        found, done = now.agg(*count).first(), done + 1
        if found == state:
            break
        state = found
    return now


def roots(edges: DataFrame) -> DataFrame:
    """Contracted edges -> (node, root): its least neighbour or itself.  Equal roots mean one component; if contraction
    stopped early, a component may have several."""
    up, down = F.greatest("u", "v"), F.least("u", "v")
    both = edges.select(up.alias("node"), down.alias("root")).union(edges.select(down, down))
    return both.groupBy("node").agg(F.min("root").alias("root"))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any orderable integers -> (node, root): root is the least node reachable.

    Self-loops and repeated edges do no harm; nodes without an edge to another node are not returned.
    """
    return roots(contracted(edges))

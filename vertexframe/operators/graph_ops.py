"""Graph utilities: bounded subtrees, parents, dangling references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import EdgeType, Graph, joined
from ..scratch import settled


def _joined(columns: tuple[str, ...]) -> Column:
    return F.col(f"`{columns[0]}`").cast("string") if len(columns) == 1 else joined([F.col(f"`{c}`") for c in columns])


def references(graph: Graph, edge: EdgeType) -> DataFrame:
    """(src_id, dst_id) of one foreign key, ids as text; rows without a reference are left out."""
    source = graph.type(edge.src)
    present = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in edge.src_cols])
    return source.df.where(present).select(source.id().cast("string").alias("src_id"), _joined(edge.src_cols).alias("dst_id"))


def subtree(graph: Graph, type_name: str, key, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Breadth-first along references from one node.

    (nodes, truncated): nodes (type, id, depth), each at its first visit; truncated (type, id, path, to,
    depth), the references of the last level whose targets are not among the nodes, and dangling ones.
    Each level joins the frontier with the foreign keys of its types; visited nodes are removed by anti
    joins, so cycles end.
    """
    start = graph.type(type_name)
    frontier = {type_name: start.df.where(start.id() == key).select(start.id().cast("string").alias("id"))}
    nodes = [frontier[type_name].select(F.lit(type_name).alias("type"), "id", F.lit(0).alias("depth"))]
    visited = dict(frontier)
    cut: list[DataFrame] = []
    for level in range(depth + 1):
        reached: dict[str, list[DataFrame]] = {}
        for edge in graph.edges:
            if edge.src not in frontier:
                continue
            out = references(graph, edge).join(frontier[edge.src], F.col("src_id") == F.col("id"), "left_semi")
            target = graph.type(edge.dst)
            there = target.df.select(_joined(edge.dst_cols).alias("dst_id"), target.id().cast("string").alias("id"))
            found = out.join(there, "dst_id", "left")
            lost = found.where("id is null") if level < depth else found
            if level == depth and edge.dst in visited:
                lost = lost.join(visited[edge.dst].withColumnRenamed("id", "seen"), F.col("id") == F.col("seen"), "left_anti")
            cut.append(lost.select(F.lit(edge.src).alias("type"), F.col("src_id").alias("id"), F.lit(edge.label).alias("path"), F.col("dst_id").alias("to"), F.lit(level).alias("depth")))
            reached.setdefault(edge.dst, []).append(found.where("id is not null").select("id"))
        if level == depth:
            break
        frontier = {}
        for name, parts in reached.items():
            new = reduce(lambda a, b: a.union(b), parts).distinct()
            if name in visited:
                new = new.join(visited[name], "id", "left_anti")
            frontier[name] = new
            visited[name] = visited[name].union(new) if name in visited else new
            nodes.append(new.select(F.lit(name).alias("type"), "id", F.lit(level + 1).alias("depth")))
        if not frontier:
            break
    schema = "type string, id string, path string, to string, depth int"
    empty = start.df.sparkSession.createDataFrame([], schema)
    return reduce(lambda a, b: a.union(b), nodes), reduce(lambda a, b: a.union(b), cut, empty)


def parents(graph: Graph, type_name: str) -> DataFrame:
    """(id, src_type, path, src_id): every reference to nodes of a type."""
    parts = [references(graph, e).select(F.col("dst_id").alias("id"), F.lit(e.src).alias("src_type"), F.lit(e.label).alias("path"), "src_id") for e in graph.edges if e.dst == type_name]
    if not parts:
        return graph.type(type_name).df.sparkSession.createDataFrame([], "id string, src_type string, path string, src_id string")
    return reduce(lambda a, b: a.union(b), parts)


def parent_counts(graph: Graph, type_name: str) -> DataFrame:
    """The node type's key columns and `parents`, 0 included; counts are pre-aggregated before the join."""
    node = graph.type(type_name)
    counts = parents(graph, type_name).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    joined = node.df.select(*node.key).join(counts.withColumnRenamed("id", "\x1fid"), _joined(node.key) == F.col("\x1fid"), "left")
    return joined.select(*node.key, F.coalesce("n", F.lit(0)).cast("long").alias("parents"))


def unreachable(graph: Graph, type_name: str) -> DataFrame:
    """Nodes of a type that nothing refers to."""
    node = graph.type(type_name)
    referred = parents(graph, type_name).select(F.col("id").alias("\x1fid")).distinct()
    return node.df.join(referred, node.id().cast("string") == F.col("\x1fid"), "left_anti")


def reachable(graph: Graph, roots: dict[str, DataFrame]) -> DataFrame:
    """(type, id): everything that references lead to from the roots (ids as text, column `id`, by type), these included.

    Each round joins the newest nodes with all references and takes out known ones; what a round finds is
    written to the shared folder, so plans stay short and cycles end.
    """
    spark = graph.type(graph.names()[0]).df.sparkSession
    links = [references(graph, e).select(F.lit(e.src).alias("src"), "src_id", F.lit(e.dst).alias("dst"), "dst_id") for e in graph.edges]
    empty = spark.createDataFrame([], "type string, id string")
    newest = settled(reduce(lambda a, b: a.union(b), [df.select(F.lit(t).alias("type"), F.col("id").cast("string").alias("id")) for t, df in roots.items()], empty).distinct())
    known = newest
    while links and not newest.isEmpty():
        edges = reduce(lambda a, b: a.union(b), links)
        found = edges.join(newest, (F.col("src") == F.col("type")) & (F.col("src_id") == F.col("id")), "left_semi").select(F.col("dst").alias("type"), F.col("dst_id").alias("id")).distinct()
        newest = settled(found.join(known, ["type", "id"], "left_anti"))
        known = known.union(newest)
    return known


def unreached(graph: Graph, type_name: str, roots: dict[str, DataFrame]) -> DataFrame:
    """Nodes of a type that no chain of references leads to from the roots."""
    node = graph.type(type_name)
    known = reachable(graph, roots).where(F.col("type") == type_name).select(F.col("id").alias("\x1fid"))
    return node.df.join(known, node.id().cast("string") == F.col("\x1fid"), "left_anti")

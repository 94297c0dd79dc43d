"""Secondary indexes as derived tables, and their statistics.

Parquet pushdown answers most lookups; these tables serve text search, expressions and checks.  An index
only narrows: callers filter again, so an index is always a superset of the full scan's answer.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Graph
from ..errors import ConstraintViolation

_EXPRESSIONS = {"lower": F.lower, "upper": F.upper, "trim": F.trim, "length": F.length}


@dataclass(frozen=True)
class Index:
    """kind: property, composite, range, text, fulltext, unique or expression (then fn is given)."""

    type: str
    props: tuple[str, ...]
    kind: str = "property"
    fn: str | None = None
    sparse: bool = True
    where: Column | None = None
    min_gram: int = 2
    max_gram: int = 4


def _folded(c: Column) -> Column:
    return F.lower(c)


def entries(graph: Graph, index: Index) -> DataFrame:
    """(key, id): the postings of an index."""
    node = graph.type(index.type)
    rows = node.df if index.where is None else node.df.where(index.where)
    columns = [F.col(f"`{p}`") for p in index.props]
    if index.sparse:
        for c in columns:
            rows = rows.where(c.isNotNull())
    first = columns[0]
    if index.kind == "expression":
        return rows.select(_EXPRESSIONS[index.fn](first).alias("key"), node.id().alias("id"))
    if index.kind == "fulltext":
        tokens = F.array_distinct(F.regexp_extract_all(_folded(first), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
        return rows.select(F.explode(tokens).alias("key"), node.id().alias("id"))
    if index.kind == "text":
        text = _folded(first)
        length = F.length(text)

        def all_of(n: int) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.greatest(length - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
            return F.when(length >= n, found).otherwise(F.array().cast("array<string>"))

        grams = [all_of(n) for n in range(index.min_gram, index.max_gram + 1)]
        return rows.select(F.explode(F.array_distinct(F.concat(*grams))).alias("key"), node.id().alias("id"))
    key = first if len(columns) == 1 else F.struct(*columns)
    return rows.select(key.alias("key"), node.id().alias("id"))


def statistics(postings: DataFrame) -> DataFrame:
    """entries, keys, max_bucket, avg_bucket and selectivity (keys over entries) of an index: one row."""
    buckets = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return buckets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries"), F.count(F.lit(1)).alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("max_bucket"), F.avg("n").alias("avg_bucket"),
    ).withColumn("selectivity", F.when(F.col("entries") > 0, F.col("keys") / F.col("entries")))


def contains(graph: Graph, index: Index, needle: str) -> DataFrame:
    """Nodes whose text contains the needle: all grams of the needle must be there, then it is checked."""
    node = graph.type(index.type)
    text = F.col(f"`{index.props[0]}`")
    folded = needle.lower()
    size = min(len(folded), index.max_gram)
    if size < index.min_gram:
        return node.df.where(F.contains(text, F.lit(needle)))
    grams = sorted({folded[i : i + size] for i in range(len(folded) - size + 1)})
    hits = entries(graph, index).where(F.col("key").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).select(F.col("id").alias("\x1fhit"))
    return node.df.join(hits, node.id() == F.col("\x1fhit"), "left_semi").where(F.contains(text, F.lit(needle)))


def verify(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings that differ between a stored and a fresh index, with what is wrong with them."""
    return stored.exceptAll(fresh).withColumn("problem", F.lit("stale")).unionByName(fresh.exceptAll(stored).withColumn("problem", F.lit("missing")))


def check_unique(graph: Graph, index: Index) -> None:
    """Raises if a key of a unique index has two nodes."""
    twice = entries(graph, index).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ConstraintViolation(f"unique index on {index.type}({', '.join(index.props)}): {', '.join(str(r.key) for r in twice)}")

"""Tables from files and databases, as the nodes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Graph
from ..errors import BindingProblem

FORMATS = ("parquet", "orc", "json", "csv")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A table of a file format; text formats need a schema, so that nothing is scanned to guess one."""
    if fmt not in FORMATS:
        raise BindingProblem(f"unknown format {fmt}")
    if fmt in ("json", "csv") and schema is None:
        raise BindingProblem(f"{fmt} needs a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema is not None else reader).format(fmt).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, *, column: str | None = None, bounds: tuple | None = None, parts: int = 1, **options) -> DataFrame:
    """A database table, read in parts by ranges of a column."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column is not None:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options) -> None:
    if fmt not in FORMATS:
        raise BindingProblem(f"unknown format {fmt}")
    writer = df.write.mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).format(fmt).save(path)


def graph_of(tables: dict[str, tuple[DataFrame, tuple[str, ...]]], edges: list[tuple] = ()) -> Graph:
    """{type: (table, key columns)} and [(label, src type, src columns, dst type)] as a graph."""
    g = Graph()
    for name, (df, key) in tables.items():
        g.node(name, df, *key)
    for edge in edges:
        g.edge(*edge)
    return g

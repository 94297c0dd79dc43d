"""Declared constraints, and their violations as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Graph
from ..errors import BindingProblem, ConstraintViolation

_KINDS = {
    "string": (T.StringType,), "boolean": (T.BooleanType,), "bigint": (T.DecimalType, T.LongType), "array": (T.ArrayType,), "object": (T.StructType, T.MapType),
    "number": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
}


@dataclass(frozen=True)
class Constraint:
    """What a property of a node type must meet; several rules can be given at once."""

    type: str
    prop: str
    required: bool = False
    kind: str | None = None
    one_of: tuple | None = None
    least: object | None = None
    most: object | None = None
    unique: bool = False
    reference: str | None = None  # an edge label whose target must exist


def declared(cls: type, name: str | None = None) -> list[Constraint]:
    """Constraints from the `constraint` entries of a dataclass's field metadata; subclasses inherit."""
    if not is_dataclass(cls):
        raise BindingProblem("constraints are declared on dataclasses")
    return [Constraint(name or cls.__name__, f.name, **f.metadata["constraint"]) for f in fields(cls) if "constraint" in f.metadata]


def constrained(**rules):
    """A dataclass field with constraints."""
    return field(metadata={"constraint": rules}, default=None)


def violations(graph: Graph, constraints: list[Constraint], changed: dict[str, DataFrame] | None = None) -> DataFrame:
    """(type, id, prop, rule, value): one row for each broken rule, none for a missing optional value.

    changed: ids (column `id`) by type; rules on fields then look at these nodes only, and uniqueness
    reports pairs that touch them.
    """
    parts = []
    for c in constraints:
        node = graph.type(c.type)
        if c.prop not in node.props and c.reference is None:
            raise BindingProblem(f"{c.type} has no property {c.prop}")
        whole, rows = node.df, node.df
        if changed is not None:
            if c.type not in changed:
                continue
            rows = rows.join(changed[c.type].select(F.col("id").alias("\x1fid")), node.id() == F.col("\x1fid"), "left_semi")
        value = F.col(f"`{c.prop}`") if c.prop in node.props else F.lit(None)

        def broken(df: DataFrame, condition: Column, rule: str, shown: Column = value) -> DataFrame:
            return df.where(condition).select(F.lit(c.type).alias("type"), node.id().cast("string").alias("id"), F.lit(c.prop).alias("prop"), F.lit(rule).alias("rule"), shown.cast("string").alias("value"))

        if c.required:
            parts.append(broken(rows, value.isNull(), "required"))
        if c.kind is not None and c.kind != "reference" and not isinstance(node.df.schema[c.prop].dataType, _KINDS[c.kind]):
            parts.append(broken(rows, value.isNotNull(), "type"))
        if c.one_of is not None:
            parts.append(broken(rows, value.isNotNull() & ~value.isin(list(c.one_of)), "enum"))
        if c.least is not None:
            parts.append(broken(rows, value < F.lit(c.least), "min"))
        if c.most is not None:
            parts.append(broken(rows, value > F.lit(c.most), "max"))
        if c.unique:
            given = whole.where(value.isNotNull())
            if node.key:
                # Counts and the first node of each value are pre-aggregated; only repeated values are joined back.
                first = given.groupBy(value.alias("\x1fv")).agg(F.min(node.order()).alias("\x1ffirst"), F.count(F.lit(1)).alias("\x1fn")).where("`\x1fn` > 1")
                later = given.join(first, value == F.col("\x1fv")).where(node.order() != F.col("\x1ffirst")).select(whole["*"])
            else:
                ranked = given.withColumn("\x1frank", F.row_number().over(Window.partitionBy(value).orderBy(node.order())))
                later = ranked.where("`\x1frank` > 1")
            if changed is not None:
                later = later.join(rows.select(value.alias("\x1fv")).distinct(), value == F.col("\x1fv"), "left_semi")
            parts.append(broken(later, F.lit(True), "unique"))
        if c.reference is not None:
            edge = next((e for e in graph.edges if e.src == c.type and e.label == c.reference), None)
            if edge is None:
                raise BindingProblem(f"{c.type} has no edge {c.reference}")
            target = graph.type(edge.dst).df.select(*[F.col(f"`{b}`").alias(f"\x1f{b}") for b in edge.dst_cols])
            on = reduce(lambda x, y: x & y, [F.col(f"`{a}`") == F.col(f"`\x1f{b}`") for a, b in zip(edge.src_cols, edge.dst_cols)])
            parts.append(broken(rows.join(target, on, "left_anti"), F.lit(True), "reference", F.concat_ws("/", *[F.col(f"`{a}`").cast("string") for a in edge.src_cols])))
    if not parts:
        session = graph.type(graph.names()[0]).df.sparkSession
        return session.createDataFrame([], "type string, id string, prop string, rule string, value string")
    return reduce(lambda a, b: a.unionByName(b), parts)


def enforce(graph: Graph, constraints: list[Constraint], changed: dict[str, DataFrame] | None = None) -> None:
    """Raises if anything is violated, naming a few."""
    found = violations(graph, constraints, changed).limit(5).collect()
    if found:
        raise ConstraintViolation("; ".join(f"{r.type}.{r.prop} of {r.id}: {r.rule}" for r in found))

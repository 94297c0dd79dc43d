"""Object graphs as tables, and as a Graph that the compiler can query.

nodes (object_id, ord, kind, type, version, lazy_key) and slots (object_id, slot_kind, pos, key, path,
label, tag, s, d, b, n, ref): a tagged value in columns, as properties of one name may differ in type.
Edges are the slots that hold references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph, NodeType
from .objects import Envelope, seen, slots_of

NODES = "object_id string, ord long, kind string, type string, version int, lazy_key string"
SLOTS = "object_id string, slot_kind string, pos int, key string, path string, label string, tag string, s string, d double, b boolean, n decimal(38,0), ref string"
_HIDDEN = ("object_id", "ord", "kind", "type")


@dataclass(frozen=True)
class Tables:
    nodes: DataFrame
    slots: DataFrame


def tables(spark: SparkSession, envelope: Envelope) -> Tables:
    nodes, slots = [], []
    for object_id, node in envelope.nodes.items():
        nodes.append((object_id, int(object_id), node["kind"], node.get("type"), node.get("version"), node.get("key")))
        for kind, pos, key, path, label, value in slots_of(node):
            tag, v = seen(value)
            slots.append((object_id, kind, pos, key, path, label, tag, v if tag == "string" else None, v if tag == "number" else None, v if tag == "boolean" else None, v if tag == "bigint" else None, v if tag == "ref" else None))
    return Tables(spark.createDataFrame(nodes, NODES), spark.createDataFrame(slots, SLOTS))


def edges(slots: DataFrame) -> DataFrame:
    return slots.where("tag = 'ref'").select(F.col("object_id").alias("src"), F.col("ref").alias("dst"), "path", "label", "pos")


_COLUMN = {"number": "d", "string": "s", "boolean": "b", "bigint": "n", "ref": "ref"}


def _text() -> Column:
    """A value of mixed type as text."""
    return F.coalesce("s", "ref", F.col("b").cast("string"), F.col("n").cast("string"), F.when(F.col("d") == F.floor("d"), F.col("d").cast("long").cast("string")).otherwise(F.col("d").cast("string")))


@dataclass(frozen=True)
class SlotType(NodeType):
    """Nodes whose properties lie in the slots table; only the wanted ones are read, by one pivot."""

    slots: DataFrame | None = None
    known: tuple[str, ...] = ()

    @property
    def props(self) -> list[str]:
        return list(self.known)

    def order(self) -> Column:
        return F.col("ord")

    def load(self, wanted: set[str]) -> DataFrame:
        wanted = sorted(p for p in wanted if not p.startswith("$"))
        if not wanted:
            return self.df
        mine = self.slots.where(F.col("path").isin(wanted))
        if self.name is not None:
            mine = mine.join(self.df.select("object_id"), "object_id", "left_semi")
        # The types of the wanted properties: as many rows as properties times tags, never nodes.
        found: dict[str, set[str]] = {}
        for r in mine.where("tag not in ('null', 'undefined')").select("path", "tag").distinct().collect():
            found.setdefault(r.path, set()).add(r.tag)
        columns = []
        for p in wanted:
            tags = found.get(p, set())
            value = F.col(_COLUMN[next(iter(tags))]) if len(tags) == 1 else _text() if tags else F.lit(None).cast("string")
            columns.append(F.max(F.when(F.col("path") == p, value)).alias(p))
        wide = mine.groupBy("object_id").agg(*columns)
        return self.df.join(wide, "object_id", "left")


def as_graph(t: Tables) -> Graph:
    """All nodes by type, everything together for untyped patterns, and the edge table."""
    graph = Graph(edge_table=edges(t.slots))
    common = {"key": ("object_id",), "hidden": _HIDDEN, "type_col": "type", "kind_col": "kind", "slots": t.slots}
    narrow = t.nodes.select("object_id", "ord", "kind", "type")
    keys: dict[str, list[str]] = {}
    for r in t.nodes.where("type is not null").join(t.slots.where("slot_kind = 'prop'"), "object_id").groupBy("type", "path").agg(F.min("pos").alias("pos")).orderBy("type", "pos", "path").collect():
        keys.setdefault(r.type, []).append(r.path)
    for r in t.nodes.where("type is not null").select("type").distinct().collect():
        graph.types[r.type] = SlotType(r.type, narrow.where(F.col("type") == r.type), known=tuple(keys.get(r.type, ())), **common)
    graph.anything = SlotType(None, narrow, **common)
    return graph


def from_objects(spark: SparkSession, envelope: Envelope) -> Graph:
    return as_graph(tables(spark, envelope))

"""What a graph consists of: node types and edge types over DataFrames.

In a relational overlay a node type is a DataFrame with a key, and an edge type is a foreign key.  In a
stored object graph (sources.objects) a node type is one kind of stored object and all edges are rows of
one edge table.  The compiler sees both through the same interface.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import BindingProblem


def joined(columns: list[Column]) -> Column:
    """Values as one id: joined by "/", which is escaped inside them; missing ones are told from empty ones."""
    parts = [F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("/"), F.lit("\\/")) for c in columns]
    return F.concat_ws("/", *[F.coalesce(p, F.lit("\\N")) for p in parts])


@dataclass(frozen=True)
class NodeType:
    """Nodes of one type.  key: the columns that identify a node (none: the whole row does)."""

    name: str | None
    df: DataFrame
    key: tuple[str, ...] = ()
    kind: str = "object"
    #: Columns that are not properties (ids, type and kind of mixed nodes).
    hidden: tuple[str, ...] = ()
    type_col: str | None = None
    kind_col: str | None = None

    @property
    def props(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.hidden]

    def load(self, wanted: set[str]) -> DataFrame:
        """Rows with at least the wanted properties that exist."""
        return self.df

    def id(self) -> Column:
        if len(self.key) == 1:
            return F.col(f"`{self.key[0]}`")
        return joined([F.col(f"`{c}`") for c in self.key or tuple(self.df.columns)])

    def order(self) -> Column:
        return F.struct(*[F.col(f"`{c}`") for c in (self.key or tuple(self.df.columns))])


@dataclass(frozen=True)
class EdgeType:
    """A foreign key: src_cols of src refer to the key (or dst_cols) of dst."""

    label: str
    src: str
    src_cols: tuple[str, ...]
    dst: str
    dst_cols: tuple[str, ...]


@dataclass
class Graph:
    """A catalog of node and edge types; edge_table (src, dst, path, label, pos) if edges are stored."""

    types: dict[str, NodeType] = field(default_factory=dict)
    edges: list[EdgeType] = field(default_factory=list)
    edge_table: DataFrame | None = None
    anything: NodeType | None = None

    #: Keys of node types, and what reads the tables of those that no query has used yet.
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unread: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def node(self, name: str, df: DataFrame | Callable[[], DataFrame], *key: str) -> Graph:
        """Adds a node type; a function is called when the type is first used."""
        self.keys[name] = tuple(key)
        if isinstance(df, DataFrame):
            self.types[name] = NodeType(name, df, tuple(key))
        else:
            self.unread[name] = df
        return self

    def names(self) -> list[str]:
        return list(dict.fromkeys([*self.keys, *self.types]))

    def edge(self, label: str, src: str, src_cols, dst: str, dst_cols=None) -> Graph:
        src_cols = (src_cols,) if isinstance(src_cols, str) else tuple(src_cols)
        dst_cols = self.keys[dst] if dst_cols is None else ((dst_cols,) if isinstance(dst_cols, str) else tuple(dst_cols))
        if len(src_cols) != len(dst_cols):
            raise BindingProblem(f"edge {label}: {len(src_cols)} columns refer to {len(dst_cols)}")
        self.edges.append(EdgeType(label, src, src_cols, dst, dst_cols))
        return self

    def type(self, name: str) -> NodeType:
        if name not in self.types:
            if name not in self.unread:
                raise BindingProblem(f"unknown node type {name}")
            self.types[name] = NodeType(name, self.unread[name](), self.keys[name])
        return self.types[name]

    def edges_between(self, src: str | None, label: str | None, dst: str | None) -> list[EdgeType]:
        return [e for e in self.edges if src in (None, e.src) and dst in (None, e.dst) and label in (None, e.label)]

    def with_nodes(self, name: str, df: DataFrame) -> Graph:
        """The same graph with other rows for one node type: graphs are never changed in place."""
        return replace(self, types={**self.types, name: replace(self.type(name), df=df)})


def overlay(spark, sf_dir: str) -> Graph:
    """The tables of a data folder as a graph."""

    def read(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    g = Graph()
    for name, table, key in (
        ("Region", "region", ("r_regionkey",)), ("Nation", "nation", ("n_nationkey",)), ("Customer", "customer", ("c_custkey",)),
        ("Supplier", "supplier", ("s_suppkey",)), ("Part", "part", ("p_partkey",)), ("Order", "orders", ("o_orderkey",)),
        ("LineItem", "lineitem", ()), ("Event", "events", ("event_id",)), ("Document", "documents", ("doc_id",)),
        ("Label", "labels", ("doc_id",)), ("Embedding", "embeddings", ("vec_id",)), ("Page", "pages", ("page_id",)),
        ("BenchmarkItem", "benchmark", ("item_id",)), ("Turn", "conversations", ("conv_id", "turn")),
    ):
        g.node(name, read(table), *key)
    g.edge("region", "Nation", "n_regionkey", "Region")
    g.edge("nation", "Customer", "c_nationkey", "Nation")
    g.edge("nation", "Supplier", "s_nationkey", "Nation")
    g.edge("customer", "Order", "o_custkey", "Customer")
    g.edge("order", "LineItem", "l_orderkey", "Order")
    g.edge("part", "LineItem", "l_partkey", "Part")
    g.edge("supplier", "LineItem", "l_suppkey", "Supplier")
    g.edge("document", "Label", "doc_id", "Document")
    return g

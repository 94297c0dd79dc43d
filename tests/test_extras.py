"""Maps, lists, stored indexes and profiles over a store; tables of several formats; graph utilities."""

import pytest
from pyspark.sql import functions as F

from vertexframe.catalog import Graph
from vertexframe.errors import BindingProblem, ConstraintViolation
from vertexframe.operators import constraints, graph_ops, indexes
from vertexframe.operators.constraints import Constraint, constrained, declared
from vertexframe.operators.indexes import Index
from vertexframe.sources.tables import graph_of, read, write
from vertexframe.store.extras import IndexStore, PersistentMap, channel, lazy_list, read_segment, safety_profile, transactional, write_lists
from vertexframe.store.store import Store


def test_persistent_map(spark, tmp_path):
    m = PersistentMap(Store(spark, str(tmp_path / "s")))
    assert m.get("a") is None and not m.has("a")
    m.set("a", {"x": [1, 2]})
    m.update({"b": None, "a": 2})
    assert m.get("a") == 2 and m.keys() == ["a", "b"] and m.values() == [2, None]
    assert m.delete("a") and not m.delete("a")
    again = PersistentMap(Store(spark, str(tmp_path / "s")))
    assert list(again.entries()) == [("b", None)]
    again.clear()
    assert again.keys() == []


def test_lists_and_channels(spark, tmp_path):
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("v"), "id").alias("v"))
    write_lists(lazy_list(df, "l1", "id", segment=10), str(tmp_path / "lists"))
    part = read_segment(spark.read.parquet(str(tmp_path / "lists")), "l1", 2)
    assert [r.id for r in part.collect()] == [20, 21, 22, 23, 24]
    assert "PartitionFilters: [isnotnull" in part._jdf.queryExecution().toString()
    found = spark.createDataFrame([("5",), ("12",), ("x",)], "k string").select(channel("k", 4).alias("c")).collect()
    assert [r.c for r in found[:2]] == [1, 0] and 0 <= found[2].c < 4


def test_indexes_in_a_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alpha beta", "t1", False), (2, "beta gamma", "t1", False), (3, "alphabet", "t2", True)], "id int, title string, tenant string, archived boolean")
    store = Store(spark, str(tmp_path / "s"), stale_lock=60)
    store.commit({"docs": docs})
    kinds = {"text": Index("Doc", ("title",), "text"), "full": Index("Doc", ("title",), "fulltext"), "pair": Index("Doc", ("tenant", "archived"), "composite", where=~F.col("archived")), "low": Index("Doc", ("title",), "expression", fn="lower")}
    index = IndexStore(store, lambda t: Graph().node("Doc", t["docs"], "id"), kinds)
    assert not index.fresh() and index.verify() == list(kinds)
    index.rebuild()
    assert index.fresh() and index.fresh("committed") and index.verify() == []
    assert sorted(r.id for r in index.postings("full").where("key = 'beta'").collect()) == [1, 2]
    assert index.postings("pair").count() == 2
    graph = Graph().node("Doc", docs, "id")
    assert [r.id for r in indexes.contains(graph, kinds["text"], "Alph").collect()] == [1] and [r.id for r in indexes.contains(graph, kinds["text"], "a").orderBy("id").collect()] == [1, 2, 3]
    store.commit({"docs": docs.where("id < 3")})
    assert not index.fresh() and index.repair() == ["text", "full", "low"] and index.fresh()
    with pytest.raises(ConstraintViolation):
        indexes.check_unique(graph, Index("Doc", ("tenant",), "unique"))
    indexes.check_unique(graph, Index("Doc", ("id",), "unique"))
    assert safety_profile(store) == {"score": 100, "issues": []}

    class Service:
        @transactional(lambda self: store, note="from a method")
        def keep(self, tables, most):
            return {"docs": tables["docs"].where(F.col("id") <= most)}

    Service().keep(1)
    assert store.table("docs").count() == 1 and store.log()[-1]["note"] == "from a method"


def test_table_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    for fmt in ("parquet", "orc", "json", "csv"):
        write(df, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, read(spark, str(tmp_path / fmt), fmt, schema="id int, s string").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(BindingProblem):
        read(spark, str(tmp_path / "json"), "json")


def test_graph_utilities(spark):
    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 99)], "id int, next int")
    g = graph_of({"N": (nodes, ("id",))}, [("next", "N", "next", "N")])
    found, cut = graph_ops.subtree(g, "N", 1, 5)
    assert sorted((int(r.id), r.depth) for r in found.collect()) == [(1, 0), (2, 1), (3, 2)] and cut.count() == 0
    found, cut = graph_ops.subtree(g, "N", 1, 1)
    assert found.count() == 2 and [(r.id, r.to) for r in cut.collect()] == [("2", "3")]
    _, cut = graph_ops.subtree(g, "N", 5, 1)
    assert [(r.id, r.to) for r in cut.collect()] == [("5", "99")]
    assert sorted(r.id for r in graph_ops.unreachable(g, "N").collect()) == [4, 5]


def test_constraints(spark):
    from dataclasses import dataclass

    @dataclass
    class Account:
        id: str = constrained(required=True, kind="string")
        email: str = constrained(unique=True)
        status: str = constrained(one_of=("active", "locked"))
        score: float = constrained(least=0, most=100, kind="number")

    rules = declared(Account)
    df = spark.createDataFrame([("acc-1", "one@example.com", "active", 5.0), ("acc-2", "two@example.com", "locked", 75.0)], "id string, email string, status string, score double")
    constraints.enforce(Graph().node("Account", df, "id"), rules)
    bad = df.union(spark.createDataFrame([("acc-3", "one@example.com", "gone", 101.0), (None, None, None, None)], df.schema))
    g = Graph().node("Account", bad, "id")
    found = {(r.prop, r.rule) for r in constraints.violations(g, rules).collect()}
    assert found == {("email", "unique"), ("status", "enum"), ("score", "max"), ("id", "required")}
    assert constraints.violations(g, rules, {"Account": bad.where("id = 'acc-2'").select("id")}).count() == 0
    with pytest.raises(ConstraintViolation):
        constraints.enforce(g, rules)
    assert constraints.violations(g, [Constraint("Account", "score", kind="string")]).count() == 3

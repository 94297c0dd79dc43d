"""Every catalogue query against its SQL in DuckDB, and what the plans must look like."""

import duckdb
import pytest

import __spark_entry__
from vertexframe.catalog import overlay
from vertexframe.engine import GraphSession
from vertexframe.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def key(row):
    return tuple((x is None, 0 if x is None else x) if not isinstance(x, str) else (False, x) for x in row)


def same(spark, duck, sf_dir, run, sql):
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    want = duck.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["nation", "n", "revenue"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(rows):
    return rows._jdf.queryExecution().toString()


def test_plans(spark, sf_dir):
    g = GraphSession(overlay(spark, sf_dir))
    text = plan(g.query('MATCH (o:Order)-[:customer]->(c:Customer) WHERE o.o_totalprice < 100 AND c.c_mktsegment = "X" RETURN o.o_orderkey AS k').rows)
    assert "Or(LessThan(o_totalprice,100.0),IsNull(o_totalprice))" in text and "EqualTo(c_mktsegment,X)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text
    text = plan(g.query("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) WHERE l.$id IS NULL RETURN d.doc_id AS id").rows)
    assert "LeftAnti" in text and "LeftOuter" not in text
    text = plan(g.query("MATCH (c:Customer)<-[:customer]-(o:Order) WHERE o.o_totalprice > 400000 RETURN DISTINCT c.c_custkey AS k").rows)
    assert "LeftSemi" in text
    text = plan(g.query("MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC LIMIT 5").rows)
    assert "TakeOrderedAndProject" in text
    text = plan(g.query("MATCH (r:Region), (n:Nation) WHERE r.r_regionkey = n.n_regionkey RETURN n.n_name AS n").rows)
    assert "CartesianProduct" not in text and "NestedLoop" not in text

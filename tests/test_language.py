"""The parser, and the semantics of values, predicates and projections."""

import random

import pytest

from vertexframe.catalog import Graph
from vertexframe.engine import GraphSession
from vertexframe.errors import BindingProblem, MutationProblem, SyntaxProblem
from vertexframe.lang.ast import And, Compare, Not, Or
from vertexframe.lang.parser import parse

BAD = [
    "", "RETURN 1", "MATCH (a RETURN a", "MATCH () RETURN 1", "MATCH (a)--(b)", "MATCH (a)-[:x]-(b)", "MATCH (a) WHERE a.x", "MATCH (a) WHERE a.x LIKE 'y'", "MATCH (a) RETURN count(DISTINCT *)",
    "MATCH (a) RETURN sum(*)", "MATCH (a) RETURN sum(a.x * 2)", "MATCH (a) RETURN nope(a.x)", "MATCH (a) RETURN lower(a.x, a.y)", "MATCH (a) LIMIT -1", "MATCH (a) LIMIT 1.5", "MATCH (a) LIMIT $n",
    "MATCH (a) MATCH (b)", "MATCH (a) WHERE a.x = 1 WHERE a.y = 2", "MATCH (a) WITH a.x AS x", "MATCH (a) WITH a.x AS x SET a.x = 1 RETURN x", "MATCH (a) MERGE (b {k: 1}) INTO a.c ON b.other",
    "MATCH (a) MERGE (b {k: 1}) INTO a.c ON a.k", "MATCH (a) CREATE (b {k: 1})", 'MATCH (a) WHERE a.x = "open', "MATCH (a) RETURN CASE WHEN a.x = 1 END", "MATCH (a) RETURN a.x; MATCH (b)", "MATCH (a)-[:x*2]->(b)",
]


@pytest.mark.parametrize("text", BAD)
def test_rejected(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_structure():
    where = parse('MATCH (a) WHERE a.x = 1 OR NOT a.y = "b \\" OR" AND (a.z > 2 OR a.kind IN [1, "c"]) RETURN a').where
    assert isinstance(where, Or) and isinstance(where.parts[1], And) and isinstance(where.parts[1].parts[0], Not)
    assert where.parts[1].parts[0].part == Compare("=", where.parts[1].parts[0].part.left, where.parts[1].parts[0].part.right)
    assert parse("MATCH (a) WHERE (a.x + 1) * 2 > 3 RETURN a.limit, a.set AS s").returns.items[0].name == "a.limit"
    assert parse("match (a) return count(*) limit 0").limit == 0
    assert parse("MATCH (a) DELETE a").returns.items[0].name == "changed"


def test_generated_queries_parse():
    rng = random.Random(7)
    for _ in range(200):
        hops = "".join(rng.choice(["-[:e]->", "<-[:*]-", "-[]->"]) + f"(b{k}{rng.choice(['', ':T'])})" for k in range(rng.randint(0, 3)))
        tests = rng.choice([" AND ", " OR "]).join(rng.choice(["NOT ", ""]) + f"a.p{k} {rng.choice(['=', '!=', '<', '>=', 'CONTAINS', 'STARTS WITH'])} {rng.choice(['1', chr(34) + 'x' + chr(34), '$p', 'a.q'])}" for k in range(rng.randint(1, 4)))
        st = parse(f"MATCH (a:T){hops} WHERE {tests} RETURN {rng.choice(['', 'DISTINCT '])}a.p AS p ORDER BY p {rng.choice(['ASC', 'DESC'])} LIMIT {rng.randint(0, 9)}")
        assert st.where is not None and len(st.matches[0].nodes) == len(st.matches[0].edges) + 1


@pytest.fixture(scope="module")
def graph(spark):
    nodes = [(1, "b", 1.0, True), (2, None, None, None), (3, "", float("nan"), False), (4, "É", -2.0, True), (5, "a_c", 10.0, None), (6, " x\t", 0.0, False)]
    links = [(1, 2), (1, 3), (1, 3), (4, None), (9, 1)]
    g = Graph().node("N", spark.createDataFrame(nodes, "id int, s string, d double, b boolean"), "id")
    return g.node("L", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(links)], "id int, src int, dst int"), "id").edge("src", "L", "src", "N").edge("dst", "L", "dst", "N")


def ids(graph, where, **params):
    return [r.id for r in GraphSession(graph).query(f"MATCH (n:N) WHERE {where} RETURN n.id AS id ORDER BY n.id", **params).rows.collect()]


@pytest.mark.parametrize(
    "where,expected",
    [
        ("n.s = 'b'", [1]), ("n.s != 'b'", [2, 3, 4, 5, 6]), ("NOT n.s = 'b'", [2, 3, 4, 5, 6]), ("n.s = null", [2]), ("n.s IS NULL", [2]), ("NOT n.s IS NULL", [1, 3, 4, 5, 6]), ("n.s = 1", []), ("n.s != 1", [1, 2, 3, 4, 5, 6]),
        ("n.d < 1", [2, 4, 6]), ("NOT n.d < 1", [1, 3, 5]), ("n.d >= 1", [1, 5]), ("NOT n.d >= 1", [2, 3, 4, 6]), ("n.d <= 1", [1, 2, 4, 6]), ("n.d > -3", [1, 4, 5, 6]), ("n.d = n.d", [1, 2, 4, 5, 6]), ("n.d != n.d", [3]),
        ("n.s > 'a'", [1, 4, 5]), ("n.s < 'a'", [2, 3, 6]), ("n.s >= ''", [1, 2, 3, 4, 5, 6]), ("n.s CONTAINS '_'", [5]), ("n.s CONTAINS ''", [1, 2, 3, 4, 5, 6]), ("NOT n.s STARTS WITH 'a'", [1, 2, 3, 4, 6]), ("n.s ENDS WITH 'c'", [5]),
        ("n.s IN ['b', null]", [1, 2]), ("NOT n.s IN ['b']", [2, 3, 4, 5, 6]), ("n.s IN 'b'", []), ("n.s IN [1, 'b']", [1]), ("n.d IN $xs", [1, 5]), ("n.b = true", [1, 4]), ("n.b != true", [2, 3, 5, 6]),
        ("trim(n.s) = 'x'", [6]), ("length(n.s) = 3", [5, 6]), ("upper(n.s) = 'B' OR lower(n.s) = 'é'", [1, 4]), ("coalesce(n.s, 'none') = 'none'", [2]), ("n.missing IS NULL AND n.id < 3", [1, 2]), ("n.d > 'abc'", [3]), ("n.$id IN [1, 2]", [1, 2]), ("n.$type = 'N' AND n.$kind = 'object' AND n.id = 1", [1]),
    ],
)
def test_predicates(graph, where, expected):
    assert ids(graph, where, xs=[1, 10.0, "b"]) == expected


def rows(graph, text, **params):
    return [tuple(r) for r in GraphSession(graph).query(text, **params).rows.collect()]


def test_joins(graph):
    assert sorted(rows(graph, "MATCH (l:L)-[:src]->(a:N), (l)-[:dst]->(b:N) RETURN a.id AS a, b.id AS b")) == [(1, 2), (1, 3), (1, 3)]
    assert sorted(rows(graph, "MATCH (n:N) OPTIONAL MATCH (n)<-[:src]-(l:L)-[:dst]->(m:N) WHERE n.id IN [1, 4] RETURN n.id AS n, m.id AS m"), key=str) == [(1, 2), (1, 3), (1, 3), (4, None)]
    assert sorted(rows(graph, "MATCH (l:L) OPTIONAL MATCH (a:N)<-[:src]-(l)-[:dst]->(b:N) RETURN l.id AS l, a.id AS a, b.id AS b"), key=str) == [(0, 1, 2), (1, 1, 3), (2, 1, 3), (3, None, None), (4, None, None)]
    assert rows(graph, "MATCH (n:N) OPTIONAL MATCH (n)<-[:src]-(l:L) WHERE l.$id IS NULL AND n.id > 3 RETURN n.id AS n, l.dst AS d ORDER BY n.id") == [(5, None), (6, None)]
    assert rows(graph, "MATCH (n:N)<-[:dst]-(l:L) WHERE l.src = 1 RETURN DISTINCT n.id AS n ORDER BY n") == [(2,), (3,)]


def test_rows(graph):
    assert rows(graph, "MATCH (n:N) RETURN n.b AS b, count(*) AS c, sum(n.d) AS s, avg(n.d) AS a, min(n.s) AS lo, max(n.s) AS hi GROUP BY n.b HAVING c > 1 ORDER BY b") == [(None, 2, 10.0, 10.0, "a_c", "a_c"), (False, 2, 0.0, 0.0, "", " x\t"), (True, 2, -1.0, -0.5, "b", "É")]
    assert rows(graph, "MATCH (n:N) WHERE n.id > 99 RETURN count(*) AS c, sum(n.d) AS s, avg(n.d) AS a") == [(0, 0.0, None)]
    assert rows(graph, "MATCH (n:N) RETURN n.id AS i ORDER BY n.s DESC LIMIT 3") == [(4,), (1,), (5,)]
    assert rows(graph, "MATCH (n:N) RETURN n.id AS i ORDER BY n.s ASC LIMIT 2") == [(2,), (3,)]
    assert rows(graph, "MATCH (n:N) WITH n.b AS b, n.id AS first, count(*) AS c GROUP BY n.b WHERE c = 2 RETURN first AS f, * ORDER BY f LIMIT 1")[0][0] == 1
    assert rows(graph, "MATCH (n:N) RETURN n LIMIT 1")[0][0].objectId == 1
    assert rows(graph, "MATCH (n:N) WHERE n.id = 6 RETURN 1 / n.d AS a")[0][0] == float("inf")


def test_errors(graph, spark):
    session = GraphSession(graph)
    for text in ("MATCH (n:Nope) RETURN n", "MATCH (n:N) WHERE m.x = 1 RETURN n", "MATCH (n:N)-[:nope]->(m:N) RETURN n", "MATCH (n:N) WHERE n.s + 1 > 2 RETURN n.id AS i", "MATCH (n:N) WITH n.id AS i RETURN n.id AS j"):
        with pytest.raises(BindingProblem):
            session.query(text)
    with pytest.raises(Exception, match="needs numbers"):
        session.query("MATCH (n:N) RETURN n.d + 1 AS x").rows.collect()
    soft = GraphSession(graph, on_type_error="null")
    assert [r.x for r in soft.query("MATCH (n:N) RETURN n.d + 1 AS x ORDER BY n.id LIMIT 2").rows.collect()] == [2.0, None]
    with pytest.raises(MutationProblem):
        session.query("MATCH (n:N) SET n.s = 'x'")
    with pytest.raises(MutationProblem):
        session.preview("MATCH (n:N) RETURN n.id AS i")
    with pytest.raises(MutationProblem):
        session.preview("MATCH (n:N) SET n.nope = 1")


def test_updates_choose_their_bindings(graph):
    session = GraphSession(graph)
    new = GraphSession(session.execute("MATCH (n:N) SET n.s = 'top' ORDER BY n.d DESC LIMIT 1").graph)
    assert [r.id for r in new.query("MATCH (n:N) WHERE n.s = 'top' RETURN n.id AS id").rows.collect()] == [3]
    gone = session.execute("MATCH (n:N) WHERE n.id = 3 DELETE n")
    assert sorted(r.operation for r in gone.changes.collect()) == ["delete", "detach", "detach"]
    assert [r.dst for r in gone.graph.types["L"].df.orderBy("id").collect()] == [2, None, None, None, 1]
    made = session.execute("MATCH (n:N) WHERE n.id IN [1, 4] CREATE (l:L {dst: 2}) INTO n.src RETURN l.src AS s, l.dst AS d")
    assert sorted(tuple(r) for r in made.rows.collect()) == [(1, 2), (4, 2)] and made.graph.types["L"].df.count() == 7
    merged = session.execute("MATCH (n:N) WHERE n.id IN [1, 4] MERGE (l:L {dst: 2}) INTO n.src ON l.dst RETURN l.src AS s, l.id AS i")
    assert merged.graph.types["L"].df.count() == 6 and (1, 0) in [tuple(r) for r in merged.rows.collect()]

"""The query catalogue over the driver's tables: each entry with the SQL that must give the same rows.

Entries of TEXTS are query texts; the others call the library.  Doubles that depend on the order of
addition are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import overlay
from ..engine import GraphSession
from ..mutate import merge_probe
from ..operators import constraints, graph_ops, indexes
from ..operators.constraints import Constraint
from ..operators.indexes import Index
from .store_queries import CALLS as STORED

#: name: (query text, parameters, SQL)
TEXTS: dict[str, tuple[str, dict, str]] = {
    "scan_type": ("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name", {}, "SELECT n_nationkey AS k, n_name AS name FROM nation"),
    "scan_metadata": ('MATCH (n:Region) WHERE n.$id IN [1, 3] RETURN n.$id AS id, n.$type AS t, n.$kind AS kind', {}, "SELECT r_regionkey AS id, 'Region' AS t, 'object' AS kind FROM region WHERE r_regionkey IN (1, 3)"),
    "scan_id_untyped": ("MATCH (n) WHERE n.$id = 1 RETURN n.$type AS t", {}, " UNION ALL ".join(f"SELECT '{t}' AS t FROM {x} WHERE {k}=1" for t, x, k in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Event", "events", "event_id"), ("Document", "documents", "doc_id"), ("Label", "labels", "doc_id"), ("Embedding", "embeddings", "vec_id"), ("Page", "pages", "page_id"), ("BenchmarkItem", "benchmark", "item_id")))),
    "scan_ids_untyped": ('MATCH (n) WHERE n.$id IN [2, "1/0"] AND n.$type != "Event" AND n.$type != "Document" RETURN n.$type AS t', {}, " UNION ALL ".join(f"SELECT '{t}' AS t FROM {x} WHERE {k}" for t, x, k in (("Region", "region", "r_regionkey=2"), ("Nation", "nation", "n_nationkey=2"), ("Customer", "customer", "c_custkey=2"), ("Supplier", "supplier", "s_suppkey=2"), ("Part", "part", "p_partkey=2"), ("Order", "orders", "o_orderkey=2"), ("Label", "labels", "doc_id=2"), ("Embedding", "embeddings", "vec_id=2"), ("Page", "pages", "page_id=2"), ("BenchmarkItem", "benchmark", "item_id=2"), ("Turn", "conversations", "conv_id=1 AND turn=0")))),
    "filter_eq": ('MATCH (o:Order) WHERE o.o_orderstatus = "F" RETURN o.o_orderkey AS k', {}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus='F'"),
    "filter_ne": ('MATCH (o:Order) WHERE o.o_orderstatus != "F" RETURN o.o_orderkey AS k', {}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F'"),
    "filter_type_strict": ('MATCH (p:Part) WHERE p.p_size = "7" OR p.p_size = 7 RETURN p.p_partkey AS k', {}, "SELECT p_partkey AS k FROM part WHERE p_size=7"),
    "filter_range_and": ("MATCH (l:LineItem) WHERE l.l_quantity >= 10 AND l.l_quantity < 12 AND l.l_discount > 0.05 RETURN l.l_orderkey AS k, l.l_linenumber AS ln, l.l_quantity AS q", {}, "SELECT l_orderkey AS k, l_linenumber AS ln, l_quantity AS q FROM lineitem WHERE l_quantity>=10 AND l_quantity<12 AND l_discount>0.05"),
    "filter_or_precedence": ('MATCH (p:Part) WHERE p.p_size = 1 OR p.p_brand = "Brand#2" AND p.p_size > 40 RETURN p.p_partkey AS k', {}, "SELECT p_partkey AS k FROM part WHERE p_size=1 OR (p_brand='Brand#2' AND p_size>40)"),
    "filter_not_parens": ('MATCH (p:Part) WHERE NOT (p.p_size < 45 OR p.p_brand = "Brand#2") RETURN p.p_partkey AS k', {}, "SELECT p_partkey AS k FROM part WHERE NOT (p_size<45 OR p_brand='Brand#2')"),
    "filter_in": ('MATCH (c:Customer) WHERE c.c_mktsegment IN ["BUILDING", "MACHINERY"] RETURN c.c_custkey AS k', {}, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY')"),
    "filter_param_in": ("MATCH (p:Part) WHERE p.p_size IN $sizes RETURN p.p_partkey AS k", {"sizes": [3, 7, 11]}, "SELECT p_partkey AS k FROM part WHERE p_size IN (3,7,11)"),
    "filter_date": ('MATCH (o:Order) WHERE o.o_orderdate >= "1998-01-01T00:00:00.000Z" RETURN o.o_orderkey AS k, o.o_orderdate AS d', {}, "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS d FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'"),
    "filter_instants": ('MATCH (o:Order) WHERE o.o_orderdate < "1995-06-17T00:00:00.000Z" AND NOT o.o_orderdate <= "1995-06-01T00:00:00.000Z" OR o.o_orderdate = "1996-02-29T00:00:00.000Z" OR "1998-07-01T00:00:00.000Z" < o.o_orderdate RETURN o.o_orderkey AS k', {}, "SELECT o_orderkey AS k FROM orders WHERE (o_orderdate < TIMESTAMP '1995-06-17' AND NOT o_orderdate <= TIMESTAMP '1995-06-01') OR o_orderdate = TIMESTAMP '1996-02-29' OR o_orderdate > TIMESTAMP '1998-07-01'"),
    "str_contains": ('MATCH (p:Part) WHERE p.p_name CONTAINS "ring" RETURN p.p_partkey AS k', {}, "SELECT p_partkey AS k FROM part WHERE contains(p_name,'ring')"),
    "str_starts_ends": ('MATCH (p:Part) WHERE p.p_name STARTS WITH "small" OR p.p_name ENDS WITH "ring" RETURN p.p_partkey AS k', {}, "SELECT p_partkey AS k FROM part WHERE starts_with(p_name,'small') OR ends_with(p_name,'ring')"),
    "null_checks": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) WHERE l.quality IS NULL AND d.lang IS NOT NULL RETURN d.doc_id AS id", {}, "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id WHERE l.quality IS NULL AND d.lang IS NOT NULL"),
    "missing_less_than": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) WHERE l.quality < 1 RETURN d.doc_id AS id", {}, "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id WHERE coalesce(l.quality<1, true)"),
    "missing_not_equal": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) WHERE NOT l.quality = 1 RETURN d.doc_id AS id", {}, "SELECT d.doc_id AS id FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id WHERE l.quality IS DISTINCT FROM 1"),
    "metadata_paths": ('MATCH (n) WHERE n.$type IN ["Region", "Nation"] RETURN n.$type AS t, count(*) AS n GROUP BY n.$type', {}, "SELECT 'Region' AS t, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation"),
    "full_scan": ("MATCH (n) RETURN n.$type AS t, count(*) AS n GROUP BY n.$type", {}, " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {x}" for t, x in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("LineItem", "lineitem"), ("Event", "events"), ("Document", "documents"), ("Label", "labels"), ("Embedding", "embeddings"), ("Page", "pages"), ("BenchmarkItem", "benchmark"), ("Turn", "conversations")))),
    "hop_out": ("MATCH (n:Nation)-[:region]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region", {}, "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey=r_regionkey"),
    "hop_in": ('MATCH (r:Region)<-[:region]-(n:Nation) WHERE r.r_name = "ASIA" RETURN n.n_name AS nation', {}, "SELECT n_name AS nation FROM region JOIN nation ON n_regionkey=r_regionkey WHERE r_name='ASIA'"),
    "hop_any": ("MATCH (a)-[:*]->(n:Nation) WHERE n.n_nationkey = 3 RETURN a.$type AS t, count(*) AS c GROUP BY a.$type", {}, "SELECT 'Customer' AS t, count(*) AS c FROM customer WHERE c_nationkey=3 HAVING count(*)>0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_nationkey=3 HAVING count(*)>0"),
    "chain_3hop": ('MATCH (o:Order)-[:customer]->(c:Customer)-[:nation]->(n:Nation)-[:region]->(r:Region) WHERE r.r_name = "EUROPE" RETURN o.o_orderkey AS k, n.n_name AS nation', {}, "SELECT o_orderkey AS k, n_name AS nation FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='EUROPE'"),
    "multi_match_join": ("MATCH (l:LineItem)-[:part]->(p:Part), (l)-[:supplier]->(s:Supplier)-[:nation]->(n:Nation) WHERE p.p_size = 5 RETURN p.p_partkey AS pk, s.s_suppkey AS sk, n.n_name AS nation, l.l_quantity AS q", {}, "SELECT p_partkey AS pk, s_suppkey AS sk, n_name AS nation, l_quantity AS q FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON s_nationkey=n_nationkey WHERE p_size=5"),
    "cycle_closure": ("MATCH (c:Customer)-[:nation]->(n:Nation)<-[:nation]-(s:Supplier), (o:Order)-[:customer]->(c) WHERE o.o_orderkey < 200 RETURN o.o_orderkey AS ok, s.s_suppkey AS sk", {}, "SELECT o_orderkey AS ok, s_suppkey AS sk FROM customer c JOIN supplier s ON c_nationkey=s_nationkey JOIN orders ON o_custkey=c_custkey WHERE o_orderkey<200"),
    "repeated_alias": ("MATCH (l:LineItem)-[:supplier]->(s:Supplier)-[:nation]->(n:Nation), (l)-[:order]->(o:Order)-[:customer]->(c:Customer)-[:nation]->(n) WHERE o.o_orderkey < 500 RETURN o.o_orderkey AS ok, s.s_suppkey AS sk, c.c_custkey AS ck", {}, "SELECT o_orderkey AS ok, s_suppkey AS sk, c_custkey AS ck FROM lineitem JOIN supplier ON l_suppkey=s_suppkey JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=s_nationkey AND o_orderkey<500"),
    "parallel_edges": ("MATCH (a:Nation)-[:region]->(r:Region)<-[:region]-(b:Nation) RETURN r.r_name AS r, count(*) AS n GROUP BY r.r_name", {}, "SELECT r_name AS r, count(*) AS n FROM nation a JOIN region ON a.n_regionkey=r_regionkey JOIN nation b ON b.n_regionkey=r_regionkey GROUP BY 1"),
    "cross_join": ("MATCH (r:Region), (n:Nation) RETURN r.r_name AS r, n.n_name AS n", {}, "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation"),
    "theta_join": ("MATCH (s:Supplier), (n:Nation) WHERE s.s_suppkey < n.n_nationkey RETURN s.s_suppkey AS s, n.n_nationkey AS n", {}, "SELECT s_suppkey AS s, n_nationkey AS n FROM supplier, nation WHERE s_suppkey<n_nationkey"),
    "optional_match": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) RETURN d.doc_id AS id, l.quality AS q", {}, "SELECT d.doc_id AS id, l.quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id"),
    "optional_chain": ("MATCH (s:Supplier) OPTIONAL MATCH (s)<-[:supplier]-(l:LineItem)-[:part]->(p:Part) WHERE s.s_acctbal > 5000 RETURN s.s_suppkey AS k, count(p.p_partkey) AS parts GROUP BY s.s_suppkey", {}, "SELECT s_suppkey AS k, count(p_partkey) AS parts FROM supplier LEFT JOIN (SELECT * FROM lineitem JOIN part ON l_partkey=p_partkey) ON l_suppkey=s_suppkey WHERE s_acctbal>5000 GROUP BY 1"),
    "optional_several": ("MATCH (n:Nation) OPTIONAL MATCH (n)<-[:nation]-(s:Supplier), (n)-[:region]->(r:Region) RETURN n.n_name AS n, r.r_name AS r, count(s) AS suppliers GROUP BY n.n_name, r.r_name", {}, "SELECT n_name AS n, r_name AS r, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey LEFT JOIN region ON n_regionkey=r_regionkey GROUP BY 1, 2"),
    "anti_join": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) WHERE l.$id IS NULL RETURN d.doc_id AS id", {}, "SELECT doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)"),
    "semi_join": ("MATCH (c:Customer)<-[:customer]-(o:Order) WHERE o.o_totalprice > 400000 RETURN DISTINCT c.c_custkey AS k", {}, "SELECT DISTINCT c_custkey AS k FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_totalprice>400000"),
    "arith": ("MATCH (l:LineItem) WHERE l.l_linenumber = 1 RETURN l.l_orderkey AS k, l.l_extendedprice * (1 - l.l_discount) AS net", {}, "SELECT l_orderkey AS k, l_extendedprice*(1-l_discount) AS net FROM lineitem WHERE l_linenumber=1"),
    "arith_division": ("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_retailprice / p.p_size AS unit", {}, "SELECT p_partkey AS k, p_retailprice/p_size AS unit FROM part"),
    "case_expr": ('MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size >= 40 THEN "big" WHEN p.p_size >= 20 THEN "mid" ELSE "small" END AS bucket', {}, "SELECT p_partkey AS k, CASE WHEN p_size>=40 THEN 'big' WHEN p_size>=20 THEN 'mid' ELSE 'small' END AS bucket FROM part"),
    "case_falsy_else": ('MATCH (p:Part) RETURN p.p_partkey AS k, CASE WHEN p.p_size > 40 THEN 1 ELSE 0 END AS big', {}, "SELECT p_partkey AS k, CASE WHEN p_size>40 THEN 1 ELSE 0 END::BIGINT AS big FROM part"),
    "scalar_fns": ("MATCH (p:Part) WHERE lower(p.p_type) CONTAINS lower($t) RETURN p.p_partkey AS k, upper(trim(p.p_name)) AS u, length(p.p_name) AS len", {"t": "ECON"}, "SELECT p_partkey AS k, upper(trim(p_name)) AS u, length(p_name) AS len FROM part WHERE contains(lower(p_type),lower('ECON'))"),
    "coalesce_fn": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) RETURN d.doc_id AS id, coalesce(l.quality, -1) AS q", {}, "SELECT d.doc_id AS id, coalesce(l.quality,-1) AS q FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id"),
    "agg_global_empty": ("MATCH (l:LineItem) WHERE l.l_quantity > 1000 RETURN count(*) AS n, sum(l.l_quantity) AS s, avg(l.l_quantity) AS a", {}, "SELECT count(*) AS n, coalesce(sum(l_quantity),0.0::DOUBLE) AS s, avg(l_quantity) AS a FROM lineitem WHERE l_quantity>1000"),
    "agg_first_value": ("MATCH (o:Order) RETURN o.o_custkey AS c, o.o_orderkey AS first, count(*) AS n GROUP BY o.o_custkey", {}, "SELECT o_custkey AS c, min(o_orderkey) AS first, count(*) AS n FROM orders GROUP BY 1"),
    "count_distinct": ("MATCH (e:Event) RETURN e.event_type AS t, count(DISTINCT e.user_id) AS users GROUP BY e.event_type", {}, "SELECT event_type AS t, count(DISTINCT user_id) AS users FROM events GROUP BY 1"),
    "count_path": ("MATCH (d:Document) OPTIONAL MATCH (d)<-[:document]-(l:Label) RETURN d.lang AS lang, count(*) AS n, count(l.quality) AS labelled GROUP BY d.lang", {}, "SELECT d.lang AS lang, count(*) AS n, count(l.quality) AS labelled FROM documents d LEFT JOIN labels l ON l.doc_id=d.doc_id GROUP BY 1"),
    "min_max_text": ("MATCH (c:Customer) RETURN c.c_nationkey AS k, min(c.c_mktsegment) AS a, max(c.c_mktsegment) AS b GROUP BY c.c_nationkey", {}, "SELECT c_nationkey AS k, min(c_mktsegment) AS a, max(c_mktsegment) AS b FROM customer GROUP BY 1"),
    "having": ("MATCH (o:Order) RETURN o.o_custkey AS c, count(*) AS n GROUP BY o.o_custkey HAVING n >= $m", {"m": 18}, "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>=18"),
    "having_no_agg": ("MATCH (n:Nation) RETURN n.n_nationkey AS k HAVING k > 20", {}, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey>20"),
    "with_pipeline": ("MATCH (o:Order)-[:customer]->(c:Customer) WITH c.c_mktsegment AS seg, o.o_orderstatus AS st, count(*) AS n GROUP BY c.c_mktsegment, o.o_orderstatus WHERE n > 1000 RETURN seg, n, st ORDER BY n DESC", {}, "SELECT seg, n, st FROM (SELECT c_mktsegment AS seg, o_orderstatus AS st, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2) WHERE n>1000"),
    "with_distinct": ("MATCH (p:Part) WITH DISTINCT p.p_brand AS b, p.p_size AS s WHERE s > 45 RETURN b, s", {}, "SELECT DISTINCT p_brand AS b, p_size AS s FROM part WHERE p_size>45"),
    "with_having": ("MATCH (l:LineItem) WITH l.l_suppkey AS s, count(*) AS n, max(l.l_quantity) AS q GROUP BY l.l_suppkey HAVING n > 50 RETURN s AS supplier, q", {}, "SELECT l_suppkey AS supplier, max(l_quantity) AS q FROM lineitem GROUP BY 1 HAVING count(*)>50"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.p_brand AS b", {}, "SELECT DISTINCT p_brand AS b FROM part"),
    "order_limit_offset": ("MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY o.o_totalprice DESC, o.o_orderkey ASC LIMIT 20 OFFSET 10", {}, "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 20 OFFSET 10"),
    "order_by_alias": ("MATCH (l:LineItem) RETURN l.l_suppkey AS s, count(*) AS n GROUP BY l.l_suppkey ORDER BY n DESC, s ASC LIMIT 10", {}, "SELECT l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, s ASC LIMIT 10"),
    "default_order_page": ("MATCH (p:Part)<-[:part]-(l:LineItem) WHERE p.p_size > 30 RETURN DISTINCT p.p_partkey AS k LIMIT 7 OFFSET 2", {}, "SELECT DISTINCT p_partkey AS k FROM part JOIN lineitem ON l_partkey=p_partkey WHERE p_size>30 ORDER BY k LIMIT 7 OFFSET 2"),
    "case_agg_with": ('MATCH (e:Event) WITH CASE WHEN e.value > 50 THEN "hi" ELSE "lo" END AS b, e.event_type AS t RETURN DISTINCT b, t', {}, "SELECT DISTINCT CASE WHEN value>50 THEN 'hi' ELSE 'lo' END AS b, event_type AS t FROM events"),
}

AGG_GROUP = "MATCH (l:LineItem) RETURN l.l_returnflag AS rf, l.l_linestatus AS ls, count(*) AS n, sum(l.l_quantity) AS q, avg(l.l_discount) AS d, min(l.l_tax) AS mn, max(l.l_tax) AS mx GROUP BY l.l_returnflag, l.l_linestatus"
FLAGSHIP = (
    "MATCH (l:LineItem)-[:order]->(o:Order)-[:customer]->(c:Customer)-[:nation]->(n:Nation)-[:region]->(r:Region), (l)-[:supplier]->(s:Supplier)-[:nation]->(n) "
    'WHERE r.r_name = "ASIA" RETURN n.n_name AS nation, count(*) AS n, sum(l.l_extendedprice) AS revenue GROUP BY n.n_name ORDER BY revenue DESC'
)


def session(spark: SparkSession, sf_dir: str) -> GraphSession:
    return GraphSession(overlay(spark, sf_dir))


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(session(spark, sf_dir).query(FLAGSHIP).rows, revenue=2)


def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(session(spark, sf_dir).query(AGG_GROUP).rows, q=2, d=6)


def set_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = session(spark, sf_dir).preview("MATCH (p:Part) WHERE p.p_size > 48 SET p.p_size = (p.p_size + 1) * 2").changes
    return changes.select(F.col("object_id").cast("long").alias("k"), F.col("before").cast("int").alias("before"), F.col("after").cast("double").alias("after"))


def set_post_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = session(spark, sf_dir).execute("MATCH (p:Part) WHERE p.p_size > 48 SET p.p_size = 0").graph
    return GraphSession(after).query("MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size AS s").rows


def set_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).execute('MATCH (p:Part) WHERE p.p_size > 48 SET p.p_brand = "none", p.p_type = p.p_brand RETURN p.p_partkey AS k, p.p_brand AS b, p.p_type AS t').rows


def remove_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).preview("MATCH (c:Customer)-[:nation]->(n:Nation) WHERE n.n_nationkey = 4 REMOVE c.c_mktsegment").changes.select(F.col("object_id").cast("long").alias("k"), "before", "operation")


def delete_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = session(spark, sf_dir).preview("MATCH (n:Nation)-[:region]->(r:Region) WHERE r.r_regionkey = 2 DELETE n").changes
    return changes.groupBy(F.col("operation").alias("op")).agg(F.count(F.lit(1)).alias("n"))


def delete_post_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = session(spark, sf_dir).execute("MATCH (n:Nation) WHERE n.n_regionkey = 2 DELETE n").graph
    return GraphSession(after).query("MATCH (c:Customer) OPTIONAL MATCH (c)-[:nation]->(n:Nation) RETURN c.c_nationkey AS k, count(*) AS customers, count(n) AS nations GROUP BY c.c_nationkey").rows


def create_post_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = session(spark, sf_dir).execute('MATCH (r:Region) CREATE (n:Nation {n_nationkey: r.r_regionkey + 100, n_name: "NEW"}) INTO r.region').graph
    return GraphSession(after).query("MATCH (n:Nation)-[:region]->(r:Region) RETURN r.r_name AS r, count(*) AS n, max(n.n_nationkey) AS top GROUP BY r.r_name").rows


def merge_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'MATCH (r:Region) MERGE (n:Nation {n_nationkey: r.r_regionkey * 2, n_name: "X"}) INTO r.region ON n.n_nationkey'
    changes = session(spark, sf_dir).execute(text).changes
    return changes.groupBy(F.col("operation").alias("op")).agg(F.count(F.lit(1)).alias("n"))


def merge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([("ASIA",), ("ATLANTIS",), ("MU",)], "r_name string")
    return merge_probe(overlay(spark, sf_dir), "Region", rows, "r_name").select(F.col("r_name").alias("name"))


def subtree_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = graph_ops.subtree(overlay(spark, sf_dir), "Order", 7, 2)
    return nodes.select(F.col("type").alias("t"), F.col("id").cast("long").alias("k"), F.col("depth").alias("d"))


def subtree_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cut = graph_ops.subtree(overlay(spark, sf_dir), "Order", 7, 1)
    return cut.select(F.col("type").alias("t"), F.col("id").cast("long").alias("k"), "path", F.col("to").cast("long").alias("target"))


def parent_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_ops.parent_counts(overlay(spark, sf_dir), "Nation").select(F.col("n_nationkey").alias("k"), "parents")


def constraint_enum_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.violations(overlay(spark, sf_dir), [Constraint("Part", "p_size", one_of=tuple(range(1, 41)))])
    return found.select(F.col("id").cast("long").alias("k"), F.col("value").cast("int").alias("value"))


def constraint_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.violations(overlay(spark, sf_dir), [Constraint("Part", "p_size", required=True, kind="number", least=5, most=40)])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def constraint_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.violations(overlay(spark, sf_dir), [Constraint("Part", "p_name", unique=True)])
    return found.select(F.col("id").cast("long").alias("k"))


def constraint_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = constraints.violations(overlay(spark, sf_dir), [Constraint("Label", "doc_id", reference="document")])
    return found.select(F.col("id").cast("long").alias("k"))


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexes.statistics(indexes.entries(overlay(spark, sf_dir), Index("Part", ("p_brand",))))
    return found.select("entries", "keys", "max_bucket")


def index_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexes.entries(overlay(spark, sf_dir), Index("Part", ("p_name",), "expression", fn="upper"))
    return found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def index_text_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexes.contains(overlay(spark, sf_dir), Index("Part", ("p_name",), "text"), "ring").select(F.col("p_partkey").alias("k"))


def fulltext_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = indexes.entries(overlay(spark, sf_dir), Index("BenchmarkItem", ("text",), "fulltext"))
    return found.groupBy(F.col("key").alias("tok")).agg(F.count(F.lit(1)).alias("n"))


_FLAGSHIP_SQL = (
    "SELECT n_name AS nation, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey "
    "JOIN supplier ON l_suppkey=s_suppkey JOIN nation ON c_nationkey=n_nationkey AND s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey WHERE r_name='ASIA' GROUP BY 1"
)
#: name: (function, SQL)
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "flagship": (flagship, _FLAGSHIP_SQL),
    "agg_group": (agg_group, "SELECT l_returnflag AS rf, l_linestatus AS ls, count(*) AS n, round(sum(l_quantity),2) AS q, round(avg(l_discount),6) AS d, min(l_tax) AS mn, max(l_tax) AS mx FROM lineitem GROUP BY 1,2"),
    "set_preview": (set_preview, "SELECT p_partkey AS k, p_size AS before, ((p_size+1)*2)::DOUBLE AS after FROM part WHERE p_size>48"),
    "set_post_image": (set_post_image, "SELECT p_partkey AS k, CASE WHEN p_size>48 THEN 0 ELSE p_size END AS s FROM part"),
    "set_returning": (set_returning, "SELECT p_partkey AS k, 'none' AS b, 'none' AS t FROM part WHERE p_size>48"),
    "remove_preview": (remove_preview, "SELECT c_custkey AS k, c_mktsegment AS before, 'remove' AS operation FROM customer WHERE c_nationkey=4"),
    "delete_detach": (delete_detach, "SELECT 'delete' AS op, count(*) AS n FROM nation WHERE n_regionkey=2 UNION ALL SELECT 'detach', (SELECT count(*) FROM customer JOIN nation ON c_nationkey=n_nationkey WHERE n_regionkey=2)+(SELECT count(*) FROM supplier JOIN nation ON s_nationkey=n_nationkey WHERE n_regionkey=2)"),
    "delete_post_image": (delete_post_image, "SELECT n_nationkey AS k, count(*) AS customers, count(n_nationkey) AS nations FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey<>2) ON c_nationkey=n_nationkey GROUP BY 1"),
    "create_post_image": (create_post_image, "SELECT r_name AS r, count(*)+1 AS n, (r_regionkey+100)::INT AS top FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY r_name, r_regionkey"),
    "merge_existing": (merge_existing, "SELECT op, count(*) AS n FROM (SELECT unnest(['merge','attach']) AS op FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey=r_regionkey AND n_nationkey=r_regionkey*2)) GROUP BY 1"),
    "merge_probe": (merge_names, "SELECT x AS name FROM (VALUES ('ASIA'),('ATLANTIS'),('MU')) t(x) WHERE x NOT IN (SELECT r_name FROM region)"),
    "subtree_depth2": (subtree_depth2, "SELECT 'Order' AS t, 7::BIGINT AS k, 0 AS d FROM orders WHERE o_orderkey=7 UNION ALL SELECT 'Customer', o_custkey, 1 FROM orders WHERE o_orderkey=7 UNION ALL SELECT 'Nation', c_nationkey, 2 FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderkey=7"),
    "subtree_truncated": (subtree_truncated, "SELECT 'Customer' AS t, c_custkey AS k, 'nation' AS path, c_nationkey::BIGINT AS target FROM orders JOIN customer ON o_custkey=c_custkey WHERE o_orderkey=7"),
    "parent_index": (parent_index, "SELECT n_nationkey AS k, (SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey)+(SELECT count(*) FROM supplier WHERE s_nationkey=n_nationkey) AS parents FROM nation"),
    "constraint_enum_range": (constraint_enum_range, "SELECT p_partkey AS k, p_size AS value FROM part WHERE p_size<1 OR p_size>40"),
    "constraint_min_max": (constraint_min_max, "SELECT 'min' AS rule, count(*) AS n FROM part WHERE p_size<5 HAVING count(*)>0 UNION ALL SELECT 'max', count(*) FROM part WHERE p_size>40 HAVING count(*)>0"),
    "constraint_unique": (constraint_unique, "SELECT p_partkey AS k FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) rn FROM part) WHERE rn>1"),
    "constraint_reference": (constraint_reference, "SELECT l.doc_id AS k FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id=l.doc_id)"),
    "index_statistics": (index_statistics, "SELECT count(*) AS entries, count(DISTINCT p_brand) AS keys, (SELECT max(c) FROM (SELECT count(*) c FROM part GROUP BY p_brand)) AS max_bucket FROM part"),
    "index_expression": (index_expression, "SELECT upper(p_name) AS key, count(*) AS n FROM part GROUP BY 1"),
    "index_text_lookup": (index_text_lookup, "SELECT p_partkey AS k FROM part WHERE contains(p_name,'ring')"),
    "fulltext_tokens": (fulltext_tokens, r"SELECT tok, count(*) AS n FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text),'[\p{L}\p{N}_]+')) AS tok FROM benchmark) GROUP BY 1"),
}


def _text_query(text: str, params: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: session(spark, sf_dir).query(text, **params).rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{name: _text_query(text, params) for name, (text, params, _) in TEXTS.items()}, **{name: f for name, (f, _) in (CALLS | STORED).items()}}


def oracle_sql() -> dict[str, str]:
    return {**{name: sql for name, (_, _, sql) in TEXTS.items()}, **{name: sql for name, (_, sql) in (CALLS | STORED).items()}}

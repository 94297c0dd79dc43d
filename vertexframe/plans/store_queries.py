"""Registered queries over stores, object graphs and their upkeep: each makes its own store in the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph, overlay
from ..operators import constraints, graph_ops
from ..operators.constraints import Constraint
from ..operators.indexes import Index
from ..scratch import shared_folder
from ..sources.object_session import ObjectSession
from ..sources.objects import Encoder, Registry
from ..store.extras import ConstraintContract, IndexStore, transactional
from ..store.objects import ObjectStore
from ..store.store import Migration, Store


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _store(spark: SparkSession, sf_dir: str, *names: str) -> Store:
    store = Store(spark, shared_folder(spark))
    store.commit(_tables(spark, sf_dir, *names))
    return store


def _graph(tables: dict[str, DataFrame]) -> Graph:
    """Regions and nations of a store."""
    return Graph().node("Region", tables["region"], "r_regionkey").node("Nation", tables["nation"], "n_nationkey").edge("region", "Nation", "n_regionkey", "Region")


def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table in each of three versions."""
    store = _store(spark, sf_dir, "region", "nation")
    store.commit({"nation": store.table("nation").where("n_regionkey <> 2")})
    store.commit({"region": store.table("region").where("r_regionkey < 3")}, drop=("nation",))
    found = [df.select(F.lit(v).cast("long").alias("version"), F.lit(n).alias("name")) for v in (1, 2, 3) for n, df in store.tables(v).items()]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.groupBy("version", "name").agg(F.count(F.lit(1)).alias("n"))


def _crashed(spark: SparkSession, sf_dir: str, phase: str) -> Store:
    """A store whose second commit (nations without region 2) broke off, opened again."""
    store = _store(spark, sf_dir, "nation")

    def crash(at: str) -> None:
        if at == phase:
            raise InterruptedError(at)

    store.fault = crash
    try:
        store.commit({"nation": store.table("nation").where("n_regionkey <> 2")})
    except InterruptedError:
        pass
    return Store(spark, store.path)


def store_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations after a commit that broke off at each phase: the new rows only from the commit mark on."""
    out = None
    for phase in ("before-prepare", "after-prepare", "after-data", "after-commit", "after-record"):
        found = _crashed(spark, sf_dir, phase).table("nation").select(F.lit(phase).alias("phase"), F.col("n_nationkey").alias("k"))
        out = found if out is None else out.unionByName(found)
    return out


def store_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a store: whether each record names the hash of the one before it, and what a changed record does to verify()."""
    store = _store(spark, sf_dir, "region")
    store.commit({"region": store.table("region").where("r_regionkey > 0")}, note="less")
    store.commit({"region": store.table("region").where("r_regionkey > 1")})
    log, sound = store.log(), store.verify().ok
    store.target.write_text("transactions/000000000002.json", store.target.read_text("transactions/000000000002.json").replace("less", "more"))
    rows = [(r["txn"], i == 0 or r["previous"] == log[i - 1]["hash"], sound, store.verify(data=False).ok) for i, r in enumerate(log)]
    return spark.createDataFrame(rows, "txn long, linked boolean, sound boolean, sound_after boolean")


def store_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys after a transaction by a decorated method, a unit of work of each kind, and a migration up and down."""
    store = _store(spark, sf_dir, "region")

    class Regions:
        @transactional(lambda self: store)
        def drop(self, tables, key):
            return {"region": tables["region"].where(F.col("r_regionkey") != key)}

    Regions().drop(0)
    store.storer("eager").put("one", store.table("region").where("r_regionkey = 1")).commit()
    store.storer("lazy").put("two", lambda: store.table("region").where("r_regionkey = 2")).commit()
    store.storer().put("three", store.table("region").where("r_regionkey = 3")).drop("one").commit()
    steps = [Migration(1, lambda t: {"region": t["region"].withColumn("r_regionkey", F.col("r_regionkey") * 10)}, lambda t: {"region": t["region"].withColumn("r_regionkey", (F.col("r_regionkey") / 10).cast("int"))})]
    store.migrate(steps, 1)
    high = store.table("region", store.version)
    store.migrate(steps, 0)
    out = high.select(F.lit("migrated").alias("name"), F.col("r_regionkey").cast("long").alias("k"))
    for name, df in store.tables().items():
        out = out.unionByName(df.select(F.lit(name).alias("name"), F.col("r_regionkey").cast("long").alias("k")))
    return out


def store_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What maintenance does to a store of four versions, and what is left in it and in its backup."""
    store = _store(spark, sf_dir, "nation")
    for k in (1, 2, 3):
        store.commit({"nation": store.table("nation").where(F.col("n_regionkey") != k)})
    done = store.maintain(keep=2)
    copy = store.backup(shared_folder(spark))
    facts = {"forgotten": len(done["forgotten"]), "collected": len(done["collected"]), "problems": len(done["problems"]), "rows": store.table("nation").count(), "copied": copy.table("nation").count(), "healthy": int(store.health() == "healthy")}
    return spark.createDataFrame(list(facts.items()), "fact string, n long")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of a stored index after a repair, with what freshness and verification said before and after."""
    store = _store(spark, sf_dir, "region", "nation")
    kept = IndexStore(store, _graph, {"by_region": Index("Nation", ("n_regionkey",))})
    kept.rebuild()
    first = kept.fresh()
    store.commit({"nation": store.table("nation").where("n_nationkey < 20")})
    second, broken = kept.fresh(), kept.verify()
    kept.repair()
    said = f"{first},{second},{'+'.join(broken)},{kept.fresh()},{len(kept.verify())}"
    return kept.postings("by_region").groupBy(F.col("key").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("said", F.lit(said))


def constraint_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored record of a validation: nations whose region is gone, and region keys out of range."""
    store = _store(spark, sf_dir, "region", "nation")
    store.commit({"region": store.table("region").where("r_regionkey <> 2")})
    contract = ConstraintContract(store, _graph, [Constraint("Nation", "n_regionkey", reference="region"), Constraint("Region", "r_regionkey", most=3)])
    contract.validate()
    found = contract.record()["validation"]["violations"]
    return spark.createDataFrame([(v["type"], v["rule"], v["count"], contract.current()) for v in found], "type string, rule string, n long, current boolean")


def constraint_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation is gone."""
    graph = overlay(spark, sf_dir)
    cut = graph.with_nodes("Nation", graph.type("Nation").df.where("n_regionkey <> 2"))
    return constraints.violations(cut, [Constraint("Customer", "c_nationkey", reference="nation")]).select(F.col("id").cast("long").alias("k"), F.col("value").cast("int").alias("nation"))


def reachable_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the references of some orders lead to, in any number of steps."""
    graph = overlay(spark, sf_dir)
    roots = graph.type("Order").df.where("o_orderkey < 20").select(F.col("o_orderkey").alias("id"))
    return graph_ops.reachable(graph, {"Order": roots}).select(F.col("type").alias("t"), F.col("id").cast("long").alias("k"))


def unreached_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations to which nothing leads from the suppliers of even keys."""
    graph = overlay(spark, sf_dir)
    roots = graph.type("Supplier").df.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))
    return graph_ops.unreached(graph, "Nation", {"Supplier": roots}).select(F.col("n_nationkey").alias("k"))


class Port:
    def __init__(self, code: str, depth: int):
        self.code, self.depth = code, depth


class Ship:
    def __init__(self, name: str, tons: int, home: Port, calls: list[Port]):
        self.name, self.tons, self.home, self.calls = name, tons, home, calls


def fleet() -> tuple[Registry, SimpleNamespace]:
    """A small object graph with shared objects and a cycle."""
    ports = [Port("OSL", 11), Port("RIX", 9), Port("GOT", 14)]
    ships = [Ship("Lind", 800, ports[0], ports[:2]), Ship("Vala", 2500, ports[0], []), Ship("Odde", 1200, ports[2], [ports[2], ports[0]])]
    root = SimpleNamespace(ships=ships, largest=ships[1])
    ports[1].lead = ships[0]
    return Registry().add(Port).add(Ship), root


def _fleet(spark: SparkSession) -> ObjectSession:
    registry, root = fleet()
    return ObjectSession(spark, Encoder(registry).encode(root))


def _objects(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _fleet(spark).query(text).rows


def object_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ships after a SET, a REMOVE, a DELETE, a CREATE and a MERGE, each on the session of the one before."""
    now = _fleet(spark)
    for text in (
        'MATCH (s:Ship) WHERE s.tons > 1000 SET s.tons = s.tons / 100',
        'MATCH (s:Ship) WHERE s.name = "Lind" REMOVE s.tons',
        'MATCH (s:Ship) WHERE s.name = "Odde" DELETE s',
        'MATCH (r)-[:largest]->(s:Ship) CREATE (n:Ship {name: "Nord", tons: 5}) INTO r.ships',
        'MATCH (r)-[:largest]->(s:Ship) MERGE (n:Ship {name: "Vala", tons: 0}) INTO r.ships ON n.name',
    ):
        now = ObjectSession(spark, now.update(text, {}, dry=False).envelope)
    return now.query("MATCH (r)-[:ships]->(l)-[:*]->(s:Ship) RETURN s.name AS name, s.tons AS tons").rows.withColumn("tons", F.col("tons").cast("double"))


def object_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects committed, changed through a loaded root, and read back: values by version."""
    registry, root = fleet()
    store = Store(spark, shared_folder(spark))
    ObjectStore(store, registry, lambda: root).store_root()
    held = ObjectStore(store, registry)
    held.update(lambda r: setattr(r.ships[0].calls[1].lead, "tons", 801))
    back = ObjectStore(store, registry).root
    rows = [(s.name, s.tons, s.home.code, s.home is back.ships[0].home, back.largest is s) for s in back.ships]
    return spark.createDataFrame(rows, "name string, tons long, home string, same_home boolean, largest boolean")


_NATION_PHASES = " UNION ALL ".join(f"SELECT '{p}' AS phase, n_nationkey AS k FROM nation" + (" WHERE n_regionkey <> 2" if new else "") for p, new in (("before-prepare", 0), ("after-prepare", 0), ("after-data", 0), ("after-commit", 1), ("after-record", 1)))
_REACHED = "WITH o AS (SELECT * FROM orders WHERE o_orderkey < 20), c AS (SELECT DISTINCT customer.* FROM customer JOIN o ON o_custkey = c_custkey), n AS (SELECT DISTINCT nation.* FROM nation JOIN c ON c_nationkey = n_nationkey)"
#: name: (function, SQL)
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "store_versions": (store_versions, "SELECT 1::BIGINT AS version, 'region' AS name, count(*) AS n FROM region UNION ALL SELECT 1, 'nation', count(*) FROM nation UNION ALL SELECT 2, 'region', count(*) FROM region UNION ALL SELECT 2, 'nation', count(*) FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 3, 'region', count(*) FROM region WHERE r_regionkey < 3"),
    "store_recovery": (store_recovery, _NATION_PHASES),
    "store_chain": (store_chain, "SELECT x::BIGINT AS txn, true AS linked, true AS sound, false AS sound_after FROM (VALUES (1), (2), (3)) t(x)"),
    "store_transactions": (store_transactions, "SELECT 'migrated' AS name, (r_regionkey * 10)::BIGINT AS k FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 'region', r_regionkey FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 'two', 2 UNION ALL SELECT 'three', 3"),
    "store_maintenance": (store_maintenance, "SELECT 'forgotten' AS fact, 2::BIGINT AS n UNION ALL SELECT 'collected', 2 UNION ALL SELECT 'problems', 0 UNION ALL SELECT 'rows', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (1, 2, 3)) UNION ALL SELECT 'copied', (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (1, 2, 3)) UNION ALL SELECT 'healthy', 1"),
    "stored_index": (stored_index, "SELECT n_regionkey::VARCHAR AS key, count(*) AS n, 'True,False,by_region,True,0' AS said FROM nation WHERE n_nationkey < 20 GROUP BY 1"),
    "constraint_contract": (constraint_contract, "SELECT 'Nation' AS type, 'reference' AS rule, count(*) AS n, true AS current FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'Region', 'max', count(*), true FROM region WHERE r_regionkey > 3 AND r_regionkey <> 2"),
    "constraint_dangling": (constraint_dangling, "SELECT c_custkey AS k, c_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"),
    "reachable_from_orders": (reachable_from_orders, f"{_REACHED} SELECT 'Order' AS t, o_orderkey AS k FROM o UNION ALL SELECT 'Customer', c_custkey FROM c UNION ALL SELECT 'Nation', n_nationkey FROM n UNION ALL SELECT DISTINCT 'Region', n_regionkey FROM n"),
    "unreached_nations": (unreached_nations, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0)"),
    "object_hops": (_objects("MATCH (s:Ship)-[:home]->(p:Port) RETURN s.name AS name, p.code AS code, p.depth AS depth"), "SELECT * FROM (VALUES ('Lind','OSL',11::DOUBLE),('Vala','OSL',11),('Odde','GOT',14)) t(name, code, depth)"),
    "object_collections": (_objects("MATCH (s:Ship)-[:calls]->(l)-[:*]->(p:Port) RETURN s.name AS name, p.code AS code, l.$kind AS kind"), "SELECT * FROM (VALUES ('Lind','OSL','array'),('Lind','RIX','array'),('Odde','GOT','array'),('Odde','OSL','array')) t(name, code, kind)"),
    "object_cycle": (_objects("MATCH (s:Ship)-[:calls]->(l)-[:*]->(p:Port)-[:lead]->(s) RETURN s.name AS name, p.code AS code"), "SELECT 'Lind' AS name, 'RIX' AS code"),
    "object_types": (_objects("MATCH (n) WHERE n.$type IS NOT NULL RETURN n.$type AS t, count(*) AS n GROUP BY n.$type"), "SELECT * FROM (VALUES ('Ship',3::BIGINT),('Port',3)) t(t, n)"),
    "object_update": (object_update, "SELECT * FROM (VALUES ('Lind',NULL::DOUBLE),('Vala',25),('Nord',5)) t(name, tons)"),
    "object_store": (object_store, "SELECT * FROM (VALUES ('Lind',801::BIGINT,'OSL',true,false),('Vala',2500,'OSL',true,true),('Odde',1200,'GOT',false,false)) t(name, tons, home, same_home, largest)"),
}

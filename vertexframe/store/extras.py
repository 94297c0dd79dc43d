"""What is built on a store: a persistent map, segmented lazy lists, stored indexes, a safety profile."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Graph
from ..errors import StoreProblem
from ..operators.constraints import Constraint, violations
from ..operators.indexes import Index, entries, verify
from .store import Store


class PersistentMap:
    """Keys to JSON values, kept in one table; every write is a commit."""

    def __init__(self, store: Store, name: str = "cache"):
        self.store, self.name = store, name

    def _rows(self) -> DataFrame:
        if self.name in self.store.manifest()["tables"]:
            return self.store.table(self.name)
        return self.store.spark.createDataFrame([], "key string, value string")

    def get(self, key: str, default=None):
        found = self._rows().where(F.col("key") == key).first()
        return default if found is None else json.loads(found.value)

    def has(self, key: str) -> bool:
        return not self._rows().where(F.col("key") == key).isEmpty()

    def set(self, key: str, value) -> None:
        self.update({key: value})

    def update(self, values: dict) -> None:
        new = self.store.spark.createDataFrame([(k, json.dumps(v)) for k, v in values.items()], "key string, value string")
        self.store.commit({self.name: self._rows().join(new, "key", "left_anti").unionByName(new)})

    def delete(self, key: str) -> bool:
        if not self.has(key):
            return False
        self.store.commit({self.name: self._rows().where(F.col("key") != key)})
        return True

    def clear(self) -> None:
        self.store.commit({self.name: self._rows().limit(0)})

    def entries(self) -> Iterator[tuple[str, object]]:
        for r in self._rows().orderBy("key").toLocalIterator():
            yield r.key, json.loads(r.value)

    def keys(self) -> list[str]:
        return [k for k, _ in self.entries()]

    def values(self) -> list:
        return [v for _, v in self.entries()]


def lazy_list(df: DataFrame, list_id: str, order: str, segment: int = 1000) -> DataFrame:
    """(list_id, segment, pos, value): a list in segments that are read on their own."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(order)) - 1
    numbered = df.select(F.lit(list_id).alias("list_id"), place.cast("long").alias("pos"), F.struct(*df.columns).alias("value"))
    return numbered.withColumn("segment", F.floor(F.col("pos") / segment)).select("list_id", "segment", "pos", "value")


def read_segment(lists: DataFrame, list_id: str, segment: int) -> DataFrame:
    """One segment; written by write_lists, no other file is opened."""
    return lists.where((F.col("list_id") == list_id) & (F.col("segment") == segment)).orderBy("pos").select("value.*")


def write_lists(lists: DataFrame, path: str) -> None:
    lists.write.mode("append").partitionBy("list_id", "segment").parquet(path)


class IndexStore:
    """Stored postings, stamped with the version and the content they were built from."""

    def __init__(self, store: Store, graph_of: Callable[[dict[str, DataFrame]], Graph], indexes: dict[str, Index]):
        self.store, self.graph_of, self.indexes = store, graph_of, indexes

    def rebuild(self) -> int:
        now = self.store.manifest()
        graph = self.graph_of(self.store.tables())
        made = {f"index_{n}": entries(graph, i) for n, i in self.indexes.items()}
        stamp = {n: t["hash"] for n, t in now["tables"].items() if not n.startswith("index_")}
        return self.store.commit(made, note=json.dumps({"index_of": now["txn"], "content": stamp}))

    def _stamp(self) -> dict | None:
        for record in reversed(self.store.log()):
            if record["note"].startswith('{"index_of"'):
                return {**json.loads(record["note"]), "txn": record["txn"]}
        return None

    def fresh(self, mode: str = "strict") -> bool:
        """strict: built from the same content; committed: nothing was committed since."""
        stamp, now = self._stamp(), self.store.manifest()
        if stamp is None:
            return False
        if mode == "committed":
            return stamp["txn"] == now["txn"]
        return stamp["content"] == {n: t["hash"] for n, t in now["tables"].items() if not n.startswith("index_")}

    def postings(self, name: str) -> DataFrame:
        """Stored postings if they are fresh, else computed ones."""
        if self.fresh():
            return self.store.table(f"index_{name}")
        return entries(self.graph_of(self.store.tables()), self.indexes[name])

    def verify(self) -> list[str]:
        """Indexes whose stored postings differ from what the tables say."""
        graph = self.graph_of(self.store.tables())
        stored = self.store.manifest()["tables"]
        return [n for n, i in self.indexes.items() if f"index_{n}" not in stored or not verify(self.store.table(f"index_{n}"), entries(graph, i)).isEmpty()]

    def repair(self) -> list[str]:
        broken = self.verify()
        if broken:
            self.rebuild()
        return broken


class ConstraintContract:
    """Declared constraints, kept beside the store with the last validation."""

    NAME = "constraints.json"

    def __init__(self, store: Store, graph_of: Callable[[dict[str, DataFrame]], Graph], constraints: list[Constraint]):
        self.store, self.graph_of, self.constraints = store, graph_of, constraints

    def record(self) -> dict:
        """Definitions and the last validation (None: never)."""
        if not self.store.target.exists(self.NAME):
            return {"constraints": [], "validation": None}
        return json.loads(self.store.target.read_text(self.NAME))

    def violations(self) -> DataFrame:
        return violations(self.graph_of(self.store.tables()), self.constraints)

    def validate(self) -> dict:
        """Checks the current version and writes the record: counts by type, property and rule."""
        counts = self.violations().groupBy("type", "prop", "rule").count().orderBy("type", "prop", "rule").collect()
        found = [{"type": r["type"], "prop": r["prop"], "rule": r["rule"], "count": r["count"]} for r in counts]
        record = {"constraints": [asdict(c) for c in self.constraints], "validation": {"version": self.store.version, "valid": not found, "violations": found}}
        self.store.target.write_text(self.NAME, json.dumps(record, sort_keys=True, default=str))
        return record

    def current(self) -> bool:
        """Whether the last validation was of this version and of these definitions."""
        known = self.record()
        same = json.loads(json.dumps([asdict(c) for c in self.constraints], default=str)) == known["constraints"]
        return same and known["validation"] is not None and known["validation"]["version"] == self.store.version


def safety_profile(store: Store) -> dict:
    """Issues with their weight, and a score from 100 down to 0."""
    issues: list[tuple[str, str]] = []
    status = store.status()
    if not store.verify(data=False).ok:
        issues.append(("chain-broken", "critical"))
    if status["state"] != "ready":
        issues.append(("recovery-pending", "critical"))
    if store.stale_lock is None:
        issues.append(("no-stale-lock-limit", "note"))
    if status["locked"]:
        issues.append(("locked", "note"))
    if len(store.target.list("versions")) < 2:
        issues.append(("single-version", "warning"))
    if store.garbage():
        issues.append(("garbage", "note"))
    weight = {"critical": 40, "warning": 10, "note": 2}
    return {"score": max(0, 100 - sum(weight[w] for _, w in issues)), "issues": [{"code": c, "weight": w} for c, w in issues]}


def transactional(store_of: Callable[[object], Store], **options):
    """A method decorator: the method gets the tables and returns the changed ones, in one transaction."""

    def wrap(method):
        @functools.wraps(method)
        def run(self, *args, **kwargs):
            return store_of(self).transaction(lambda tables: method(self, tables, *args, **kwargs), **options)

        return run

    return wrap


def channel(object_id, channels: int):
    """The channel of an id: a power of two of them, numeric ids by remainder, others by hash."""
    if channels < 1 or channels & (channels - 1):
        raise StoreProblem("the number of channels is a power of two")
    number = F.col(object_id).try_cast("bigint") if isinstance(object_id, str) else object_id.try_cast("bigint")
    text = F.col(object_id) if isinstance(object_id, str) else object_id
    return F.pmod(F.coalesce(number, F.hash(text).cast("bigint")), F.lit(channels)).cast("int")

"""Sessions: query texts in, DataFrames out."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Graph
from .errors import MutationProblem
from .lang.ast import And, Statement
from .lang.parser import parse
from .plans.expr import Compiler
from .plans.match import ID, Bindings, column, match, semi_aliases
from .plans.project import finish, is_aggregate, needs_order


@dataclass
class QueryResult:
    """A lazy result.  rows: what RETURN gives; changes: what an update would do or did."""

    statement: Statement
    rows: DataFrame
    bindings: Bindings
    operations: list[str] = field(default_factory=list)
    changes: DataFrame | None = None
    graph: Graph | None = None

    def matched(self) -> int:
        """Bindings that pass WHERE (runs a job)."""
        return self.bindings.df.count()

    def plan(self, counts: bool = False) -> dict:
        """Operations; for each alias its type and where its candidates come from; the filters that reach the scans.

        counts: also candidates by alias, bindings, rows and seconds (runs jobs).
        """
        text = self.rows._jdf.queryExecution().executedPlan().toString()
        pushed = sorted({f for part in re.findall(r"PushedFilters: \[(.*?)\]", text) for f in re.split(r", (?=[A-Z])", part) if f})
        types = self.bindings.types
        sources = {a: {"type": t.name, "source": "all nodes" if t.name is None else "type scan"} for a, t in types.items()}
        out = {"operations": list(self.operations), "candidates": sources, "pushed": pushed, "scans": len(re.findall(r"FileScan|Scan ExistingRDD|LocalTableScan", text))}
        if counts:
            began = time.time()
            for a, t in types.items():
                sources[a]["count"] = t.df.count() if t.name is not None else sum(self.bindings.graph.type(n).df.count() for n in self.bindings.graph.names())
            out |= {"bindings": self.matched(), "rows": self.rows.count()}
            out["seconds"] = round(time.time() - began, 3)
        return out

    def explain(self) -> str:
        """The operations of the statement and Spark's plan for it."""
        return "\n".join([*self.operations, "", self.rows._jdf.queryExecution().toString()])


class GraphSession:
    """Runs statements over one version of a graph; updates give a new graph and leave this one as it is."""

    def __init__(self, graph: Graph, on_type_error: str = "raise"):
        if on_type_error not in ("raise", "null"):
            raise ValueError("on_type_error is 'raise' or 'null'")
        self.graph, self.on_type_error = graph, on_type_error

    def _bindings(self, st: Statement, params: dict, order: bool) -> Bindings:
        semi = {
            alias: (lambda parts: lambda scope: reduce(lambda x, y: x & y, [Compiler(scope, params, self.on_type_error).predicate(c) for c in parts], F.lit(True)))(parts)
            for alias, parts in semi_aliases(st).items()
        }
        def narrowed(found: Bindings) -> Bindings:
            where = st.where
            if semi and not any(column(a, ID) in found.df.columns for a in semi):
                # Their conditions were applied before the semi joins.
                left = [c for c in (where.parts if isinstance(where, And) else [where] if where is not None else []) if not any(c in parts for parts in semi_aliases(st).values())]
                where = And(tuple(left)) if left else None
            if where is None:
                return found
            condition = Compiler(found, params, self.on_type_error).predicate(where)
            return Bindings(found.df.where(condition), found.graph, found.types, found.optional)

        return match(self.graph, st, params, order, semi or None, narrowed)

    def query(self, text: str, **params) -> QueryResult:
        """Runs a reading statement."""
        st = parse(text)
        if st.updates:
            raise MutationProblem("this statement updates; use preview or execute")
        bindings = self._bindings(st, params, needs_order(st))
        return QueryResult(st, finish(bindings, st, params, self.on_type_error), bindings, operations(st))

    def preview(self, text: str, **params) -> QueryResult:
        """The changes of an updating statement, without making them."""
        from .mutate import run_update

        return run_update(self, parse(text), params, dry=True)

    def execute(self, text: str, **params) -> QueryResult:
        """Applies an updating statement: the result's graph holds the new version."""
        from .mutate import run_update

        st = parse(text)
        return run_update(self, st, params, dry=False) if st.updates else self.query(text, **params)


def operations(st: Statement) -> list[str]:
    """The logical operations of a statement, in the order in which they apply."""
    out = [f"match:{p.nodes[0].alias}:{len(p.edges)}" for p in st.matches]
    if len(st.matches) > 1:
        out.append(f"multi-match:{len(st.matches)}")
    out += [f"optional-match:{p.nodes[0].alias}" for p in st.optional]
    if st.where is not None:
        out.append("where-filter")
    out += [f"{verb}:{len(items)}" for verb, items in (("set", st.sets), ("remove", st.removes), ("delete", st.deletes), ("create", st.creates), ("merge", st.merges)) if items]
    for name, p in (("with", st.with_), ("return", st.returns)):
        if p is None:
            continue
        out.append(f"{name}-aggregate" if is_aggregate(p) else f"{name}-project")
        out += ["having-filter"] * (p.having is not None) + [f"{name}-where"] * (p.where is not None) + ["distinct"] * p.distinct
    out += ["order"] * bool(st.order) + ["page"] * (st.limit is not None or st.offset is not None)
    return out

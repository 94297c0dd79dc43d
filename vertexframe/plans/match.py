"""Patterns as joins.

Each alias becomes a DataFrame of its node type, projected to what the statement reads of it, with columns
`alias<SEP>property`; each hop becomes an equality between columns.  Mandatory patterns are inner joins
along these equalities; a whole optional pattern is one sub-plan, joined from the left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import EdgeType, Graph, NodeType
from ..errors import BindingProblem
from ..lang.ast import And, Compare, ListOf, Literal, Name, Not, Or, Param, Path, Pattern, Statement, walk
from .expr import Scope, Value

SEP = "\x1f"
ID, ORD, TYPE, KIND = "$id", "$ord", "$type", "$kind"


def column(alias: str, prop: str) -> str:
    return f"{alias}{SEP}{prop}"


def ref(alias: str, prop: str) -> Column:
    return F.col(f"`{column(alias, prop)}`")


@dataclass(frozen=True)
class Hop:
    """src -[label]-> dst between aliases; edge: the foreign key, or None for the edge table."""

    src: str
    dst: str
    label: str | None
    edge: EdgeType | None = None


@dataclass
class Needs:
    """Properties that a statement reads, by alias; `everything`: aliases shown whole."""

    props: dict[str, set[str]]
    everything: set[str]
    order: bool


def needs(st: Statement, aliases: list[str]) -> Needs:
    props: dict[str, set[str]] = {a: set() for a in aliases}
    whole: set[str] = set()
    parts = [st.where, st.sets, st.removes, st.creates, st.merges, st.order]
    projection = st.with_ or st.returns
    parts += [projection.items, projection.group]
    if st.with_ is None:
        parts.append(st.returns.having)
    for node in walk(parts):
        if isinstance(node, Path) and node.alias in props:
            props[node.alias].add(node.prop)
    for item in projection.items:
        if type(item.expr).__name__ == "Star":
            whole.update(aliases)
        elif isinstance(item.expr, Name) and item.expr.name in props:
            whole.add(item.expr.name)
    return Needs(props, whole, False)


class Bindings(Scope):
    """The relation of matches, and the values its columns stand for."""

    def __init__(self, df: DataFrame, graph: Graph, types: dict[str, NodeType], optional: set[str]):
        self.df, self.graph, self.types, self.optional = df, graph, types, optional

    def path(self, p: Path) -> Value:
        if p.alias not in self.types:
            raise BindingProblem(f"unknown alias {p.alias}")
        name = column(p.alias, p.prop)
        bound = ref(p.alias, ID) if p.alias in self.optional and column(p.alias, ID) in self.df.columns else None
        if name not in self.df.columns:
            return Value(F.lit(None), T.NullType(), False, None, bound)
        return Value(F.col(f"`{name}`"), self.df.schema[name].dataType, bound=bound)

    def name(self, n: Name) -> Value:
        if n.name not in self.types:
            raise BindingProblem(f"unknown name {n.name}")
        return self.path(Path(n.name, ID))

    def order(self) -> list[Column]:
        return [ref(a, ORD) for a in self.types if column(a, ORD) in self.df.columns]


def _hops(patterns: list[Pattern]) -> list[tuple[str, str, str | None]]:
    out = []
    for p in patterns:
        for left, edge, right in zip(p.nodes, p.edges, p.nodes[1:]):
            pair = (left.alias, right.alias) if edge.out else (right.alias, left.alias)
            out.append((*pair, edge.label))
    return out


def _declared(patterns: list[Pattern]) -> dict[str, str | None]:
    """alias -> type name, in order of appearance."""
    out: dict[str, str | None] = {}
    for p in patterns:
        for n in p.nodes:
            if out.get(n.alias) and n.type and out[n.alias] != n.type:
                raise BindingProblem(f"{n.alias} has two types")
            out[n.alias] = out.get(n.alias) or n.type
    return out


def _type_limits(where, params: dict) -> dict[str, set[str]]:
    """Aliases whose type the WHERE fixes by `$type = ...` or `$type IN ...` in its conjunction."""
    out: dict[str, set[str]] = {}
    for part in where.parts if isinstance(where, And) else [where] if where is not None else []:
        if isinstance(part, Compare) and part.op in ("=", "IN") and isinstance(part.left, Path) and part.left.prop == TYPE:
            right = part.right
            items = [x.value for x in right.items if isinstance(x, Literal)] if isinstance(right, ListOf) else params.get(right.name) if isinstance(right, Param) else right.value if isinstance(right, Literal) else None
            if items is not None:
                found = set(items if isinstance(items, (list, tuple)) else [items])
                out[part.left.alias] = out.get(part.left.alias, found) & found
    return out


def assignments(graph: Graph, declared: dict[str, str | None], hops: list[tuple], limits: dict[str, set[str]]) -> list[tuple[dict[str, NodeType], list[Hop]]]:
    """Every way to give aliases types and hops edges; a stored object graph has just one."""
    if graph.edge_table is not None:
        return [({a: graph.type(t) if t else graph.anything for a, t in declared.items()}, [Hop(*h) for h in hops])]
    for t in declared.values():
        if t is not None and t not in graph.names():
            raise BindingProblem(f"unknown node type {t}")
    ways: list[tuple[dict[str, str], list[Hop]]] = [({a: t for a, t in declared.items() if t}, [])]
    for src, dst, label in hops:
        ways = [
            ({**types, src: e.src, dst: e.dst}, [*chosen, Hop(src, dst, label, e)])
            for types, chosen in ways
            for e in graph.edges_between(types.get(src), label, types.get(dst))
        ]
    for alias in declared:
        ways = [({**types, alias: t}, chosen) for types, chosen in ways for t in ([types[alias]] if alias in types else graph.names())]
    ways = [w for w in ways if all(w[0][a] in names for a, names in limits.items() if a in w[0])]
    return [({a: graph.type(types[a]) for a in declared}, chosen) for types, chosen in ways]


def node_frame(node: NodeType, alias: str, wanted: set[str], everything: bool, order: bool) -> DataFrame:
    """The columns of one alias."""
    columns = []
    base = node.load(wanted | set(node.props if everything else ()))
    there = [c for c in base.columns if c not in node.hidden]
    for prop in there if everything else sorted(p for p in wanted if p in there):
        columns.append(F.col(f"`{prop}`").alias(column(alias, prop)))
    columns.append(node.id().alias(column(alias, ID)))
    if TYPE in wanted or everything:
        columns.append((F.col(node.type_col) if node.type_col else F.lit(node.name)).alias(column(alias, TYPE)))
    if KIND in wanted or everything:
        columns.append((F.col(node.kind_col) if node.kind_col else F.lit(node.kind)).alias(column(alias, KIND)))
    if order:
        columns.append(node.order().alias(column(alias, ORD)))
    return base.select(*columns)


@dataclass
class Relation:
    name: str
    df: DataFrame


def _edge_frame(graph: Graph, k: int, label: str | None) -> Relation:
    edges = graph.edge_table
    if label is not None:
        edges = edges.where((F.col("label") == label) | (F.col("path") == label))
    name = f"\x1ee{k}"
    return Relation(name, edges.select(F.col("src").alias(column(name, "src")), F.col("dst").alias(column(name, "dst")), F.struct("src", "pos").alias(column(name, ORD))))


@dataclass
class Rules:
    """Rewrites that WHERE and RETURN allow.

    anti: aliases of optional patterns that WHERE wants unbound; semi: mandatory aliases that only filter
    a DISTINCT result, with the conditions on them.
    """

    anti: frozenset = frozenset()
    semi: dict | None = None


def _join(relations: list[Relation], links: list[tuple[str, str, Column]], semi: frozenset = frozenset()) -> DataFrame | None:
    """Joins relations along links (a, b, condition), in order of appearance, products last."""
    have: set[str] = set()
    df, left, used = None, list(relations), set()
    while left:
        pick = next((r for r in left if any(r.name in (a, b) and ({a, b} - {r.name}) <= have for a, b, _ in links)), None) if have else left[0]
        product = pick is None
        pick = pick or left[0]
        left.remove(pick)
        have.add(pick.name)
        on = [i for i, (a, b, _) in enumerate(links) if a in have and b in have and i not in used]
        used.update(on)
        condition = reduce(lambda x, y: x & y, [links[i][2] for i in on]) if on else None
        if df is None:
            df = pick.df if condition is None else pick.df.where(condition)
        elif condition is None or product and not on:
            df = df.crossJoin(pick.df)
        else:
            df = df.join(pick.df, condition, "left_semi" if pick.name in semi else "inner")
    late = [c for i, (a, b, c) in enumerate(links) if i not in used and a in have and b in have]
    for condition in late:
        df = df.where(condition)
    return df


def _match_one(graph: Graph, st: Statement, types: dict[str, NodeType], hops: list[Hop], mandatory: set[str], order: bool, params: dict, rules: Rules) -> Bindings:
    want = needs(st, list(types))
    keys: dict[str, set[str]] = {a: set() for a in types}
    for h in hops:
        if h.edge is not None:
            keys[h.src].update(h.edge.src_cols)
            keys[h.dst].update(h.edge.dst_cols)
    frames = {a: Relation(a, node_frame(t, a, want.props[a] | keys[a], a in want.everything, order)) for a, t in types.items()}

    def links_of(own: list[tuple[int, Hop]], rename: dict[str, str]) -> tuple[list[Relation], list[tuple[str, str, Column]]]:
        extra, links = [], []
        for k, h in own:
            src, dst = rename.get(h.src, h.src), rename.get(h.dst, h.dst)
            if h.edge is not None:
                condition = reduce(lambda x, y: x & y, [ref(src, a) == ref(dst, b) for a, b in zip(h.edge.src_cols, h.edge.dst_cols)])
                links.append((src, dst, condition))
            else:
                edge = _edge_frame(graph, k, h.label)
                extra.append(edge)
                links += [(src, edge.name, ref(src, ID) == ref(edge.name, "src")), (edge.name, dst, ref(edge.name, "dst") == ref(dst, ID))]
        return extra, links

    n_first = len(_hops(st.matches))
    numbered = list(enumerate(hops))
    extra, links = links_of(numbered[:n_first], {})
    semi = rules.semi or {}
    for alias, condition in semi.items():
        frames[alias] = Relation(alias, frames[alias].df.where(condition(Bindings(frames[alias].df, graph, {alias: types[alias]}, set()))))
    first = sorted((a for a in types if a in mandatory), key=lambda a: a in semi)
    df = _join(_in_order([frames[a] for a in first], extra, links), links, frozenset(semi))
    have, unsure = set(first), set()
    at = n_first
    for pattern in st.optional:
        own = numbered[at : at + len(pattern.edges)]
        at += len(pattern.edges)
        names = list(dict.fromkeys(n.alias for n in pattern.nodes))
        shared, new = [a for a in names if a in have], [a for a in names if a not in have]
        if not new:
            continue
        # The part of the pattern that is new, and the links that tie it to what is bound.
        extra, links = links_of(own, {})
        inner = [l for l in links if l[0] not in shared and l[1] not in shared]
        outer = [l for l in links if l[0] in shared or l[1] in shared]
        members = _in_order([frames[a] for a in new], extra, inner)
        if _components([r.name for r in members], inner) > 1:
            # It hangs together only through a bound alias: match it with a copy of that.
            rename = {a: f"{a}\x1d" for a in shared}
            extra, links = links_of(own, rename)
            copies = [Relation(rename[a], node_frame(types[a], rename[a], keys[a], False, False)) for a in shared]
            part = _join(_in_order([*copies, *[frames[a] for a in new]], extra, links), links)
            condition = reduce(lambda x, y: x & y, [ref(a, ID) == ref(rename[a], ID) for a in shared])
            df = _left(df, part, condition, bool(rules.anti & set(new))).drop(*[c for c in part.columns if c.split(SEP)[0] in rename.values()])
        else:
            part = _join(members, inner)
            condition = reduce(lambda x, y: x & y, [c for _, _, c in outer]) if outer else F.lit(True)
            df = _left(df, part, condition, bool(rules.anti & set(new)))
        have.update(new)
        unsure.update(new)
    return Bindings(df, graph, types, unsure)


def _left(df: DataFrame, part: DataFrame, condition: Column, anti: bool) -> DataFrame:
    """Left join; if only unmatched rows are wanted, an anti join with the missing columns as nulls."""
    if not anti:
        return df.join(part, condition, "left")
    return df.join(part, condition, "left_anti").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in part.schema])


def _in_order(nodes: list[Relation], edges: list[Relation], links: list) -> list[Relation]:
    """Node relations, each followed by the edge relations that start from those before."""
    out: list[Relation] = []
    waiting = list(edges)
    for n in nodes:
        out.append(n)
        names = {r.name for r in out}
        for e in list(waiting):
            if any(e.name in (a, b) and ({a, b} - {e.name}) <= names for a, b, _ in links):
                out.append(e)
                waiting.remove(e)
    return out + waiting


def _components(names: list[str], links: list) -> int:
    parent = {n: n for n in names}

    def find(x: str) -> str:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in links:
        if a in parent and b in parent:
            parent[find(a)] = find(b)
    return len({find(n) for n in names})


def _conjuncts(where) -> list:
    return list(where.parts) if isinstance(where, And) else [] if where is None else [where]


def anti_aliases(st: Statement) -> frozenset:
    """Aliases x for which WHERE demands `x.$id IS NULL`."""
    return frozenset(c.left.alias for c in _conjuncts(st.where) if isinstance(c, Compare) and c.op == "IS NULL" and isinstance(c.left, Path) and c.left.prop == ID)


def semi_aliases(st: Statement) -> dict[str, list]:
    """Leaf aliases of the patterns that a DISTINCT result does not show -> their conjuncts of WHERE."""
    p = st.with_ or st.returns
    if not p.distinct or p.group or st.optional or st.updates or st.limit is not None or st.offset is not None:
        return {}
    shown = [n for n in walk([p.items, st.order, p.having])]
    if any(type(n).__name__ in ("Star", "Aggregate") for n in shown):
        return {}
    used = {n.alias for n in shown if isinstance(n, Path)} | {n.name for n in shown if isinstance(n, Name)}
    hops = _hops(st.matches)
    out: dict[str, list] = {}
    for alias in _declared(st.matches):
        ends = [h for h in hops if alias in h[:2]]
        if alias in used or len(ends) != 1 or ends[0][0] == ends[0][1]:
            continue
        mine = [c for c in _conjuncts(st.where) if any(isinstance(n, Path) and n.alias == alias for n in walk(c))]
        if all({n.alias for n in walk(c) if isinstance(n, Path)} == {alias} for c in mine) and not any(o in out for o in ends[0][:2]):
            out[alias] = mine
    return out


def match(graph: Graph, st: Statement, params: dict, order: bool, semi: dict | None = None, narrowed: Callable[[Bindings], Bindings] = lambda found: found) -> Bindings:
    """The bindings of a statement; narrowed applies WHERE, to each typing of an untyped pattern before they are put
    together, so that a comparison sees values of their own type and filters reach the scans."""
    declared = _declared([*st.matches, *st.optional])
    mandatory = set(_declared(st.matches))
    hops = _hops(st.matches) + _hops(st.optional)
    limits = {a: names for a, names in _type_limits(st.where, params).items() if a in mandatory}
    ways = assignments(graph, declared, hops, limits)
    if not ways:
        raise BindingProblem("no node and edge types fit the patterns")
    rules = Rules(anti_aliases(st), semi if len(ways) == 1 and graph.edge_table is None else None)
    made = [narrowed(_match_one(graph, st, types, chosen, mandatory, order, params, rules)) for types, chosen in ways]
    if len(made) == 1:
        return made[0]
    return _union(made)


def _union(made: list[Bindings]) -> Bindings:
    """All ways together; a property that differs in type becomes text, ids and ordinals too."""
    names = list(dict.fromkeys(c for b in made for c in b.df.columns))
    frames = []
    for b in made:
        columns = []
        for c in names:
            kinds = {m.df.schema[c].dataType.simpleString() for m in made if c in m.df.columns}
            if c not in b.df.columns:
                columns.append(F.lit(None).cast("string" if len(kinds) > 1 else next(iter(kinds))).alias(c))
            elif len(kinds) == 1:
                columns.append(F.col(f"`{c}`"))
            elif c.endswith(ORD):
                columns.append(F.to_json(F.col(f"`{c}`")).alias(c))
            else:
                columns.append(F.col(f"`{c}`").cast("string").alias(c))
        frames.append(b.df.select(*columns))
    df = reduce(lambda x, y: x.unionByName(y), frames)
    return Bindings(df, made[0].graph, {a: replace(t, name=None) for a, t in made[0].types.items()}, made[0].optional)

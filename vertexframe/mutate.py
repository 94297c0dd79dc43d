"""Updates as change sets over immutable graphs.

A statement's bindings are turned into rows (object_id, alias, path, before, after, operation); a preview
stops there.  Otherwise the node tables are patched by joins into a new Graph: nothing is changed in place.

In a relational overlay a collection is the inverse of a foreign key: `CREATE (n:T {...}) INTO a.label`
makes a T whose edge `label` refers to a; MERGE looks for its key among the T that refer to a.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import EdgeType, Graph, NodeType, joined
from .errors import BindingProblem, MutationProblem
from .lang.ast import Aggregate, Item, Literal, Path, Statement
from .plans.expr import Compiler, Value, printed
from .plans.match import Bindings, ID, KIND, TYPE, column, node_frame, ref
from .plans.project import finish, page, sorted_bindings

CHANGES = ("object_id", "alias", "path", "before", "after", "operation")


def _row(object_id: Column, alias, path, before: Column, after: Column, operation: str) -> list[Column]:
    values = (object_id.cast("string"), F.lit(alias), F.lit(path), before.cast("string"), after.cast("string"), F.lit(operation))
    return [v.alias(n) for v, n in zip(values, CHANGES)]


def _replace(node, known: dict[Path, object]):
    """An expression with paths replaced by what earlier items of the statement set them to."""
    if isinstance(node, Path):
        return known.get(node, node)
    if isinstance(node, tuple):
        return tuple(_replace(x, known) for x in node)
    if hasattr(node, "__dataclass_fields__"):
        return type(node)(**{f: _replace(getattr(node, f), known) for f in node.__dataclass_fields__})
    return node


def _node(bindings: Bindings, alias: str) -> NodeType:
    if alias not in bindings.types:
        raise BindingProblem(f"unknown alias {alias}")
    node = bindings.types[alias]
    if node.name is None:
        raise MutationProblem(f"{alias} needs a type to be updated")
    return node


def run_update(session, st: Statement, params: dict, dry: bool):
    from .engine import QueryResult, operations

    if not st.updates:
        raise MutationProblem("this statement does not update")
    bindings = session._bindings(st, params, True)
    keys = sorted_bindings(bindings, st) if st.order else bindings.order()
    if st.limit is not None or st.offset is not None:
        df = bindings.df.orderBy(*keys) if keys else bindings.df
        bindings = Bindings(page(df, st), bindings.graph, bindings.types, bindings.optional)
    graph, changes = session.graph, []
    compiler = Compiler(bindings, params, session.on_type_error)
    known: dict[Path, object] = {}
    assigned: list[tuple[Path, Value]] = []
    for item in st.sets:
        node = _node(bindings, item.target.alias)
        if item.target.prop not in node.props:
            raise MutationProblem(f"{node.name} has no property {item.target.prop}")
        value = compiler.value(_replace(item.value, known) if not dry else item.value)
        before = bindings.path(item.target)
        changes.append(bindings.df.where(ref(item.target.alias, ID).isNotNull()).select(*_row(ref(item.target.alias, ID), item.target.alias, item.target.prop, printed(before), printed(value) if value.kind != "null" else value.col, "set")))
        assigned.append((item.target, value))
        known[item.target] = _replace(item.value, known)
    for path in st.removes:
        node = _node(bindings, path.alias)
        if path.prop not in node.props:
            raise MutationProblem(f"{node.name} has no property {path.prop}")
        before = bindings.path(path)
        changes.append(bindings.df.where(before.col.isNotNull()).select(*_row(ref(path.alias, ID), path.alias, path.prop, printed(before), F.lit(None), "remove")))
        assigned.append((path, Value(F.lit(None).cast(before.type), before.type)))
        known[path] = Literal(None)
    if not dry:
        for alias in dict.fromkeys(p.alias for p, _ in assigned):
            items = [(p.prop, v) for p, v in assigned if p.alias == alias]
            graph = _rewritten(graph, st, bindings, items, params, session.on_type_error) if _single(st, bindings) else _patched(graph, bindings, alias, items)
    for alias in st.deletes:
        targets = bindings.df.where(ref(alias, ID).isNotNull()).select(ref(alias, ID).alias("\x1fid")).distinct()
        graph, made = _deleted(graph, _node(bindings, alias), alias, targets)
        changes += made
    created = bindings
    for item in [*st.creates, *st.merges]:
        graph, made, created = _created(graph, created, item, Compiler(bindings, params, session.on_type_error))
        changes += made
    out = reduce(lambda x, y: x.unionByName(y), changes)
    returns = st.returns
    if known and not dry and not st.deletes:
        returns = replace(returns, items=tuple(Item(_replace(i.expr, known) if not isinstance(i.expr, Aggregate) else i.expr, i.name, i.explicit) for i in returns.items))
    rows = finish(created, Statement(returns=returns, order=st.order if all(not isinstance(k.expr, Path) for k in st.order) else []), params, session.on_type_error)
    return QueryResult(st, rows, bindings, operations(st), out, session.graph if dry else graph)


def _single(st: Statement, bindings: Bindings) -> bool:
    """Whether the statement reads nothing but the nodes of one table, all that pass WHERE."""
    return len(st.matches) == 1 and not st.matches[0].edges and not st.optional and st.limit is None and st.offset is None and bindings.graph.edge_table is None and next(iter(bindings.types.values())).name is not None


def _rewritten(graph: Graph, st: Statement, bindings: Bindings, items: list[tuple[str, Value]], params: dict, on_type_error: str) -> Graph:
    """The graph with properties of the nodes that pass WHERE set, in one pass over the table."""
    (alias, node), values = next(iter(bindings.types.items())), dict(items)
    whole = node_frame(node, alias, {ID, TYPE, KIND}, True, False)
    scope = Bindings(whole, graph, bindings.types, bindings.optional)
    hit = F.coalesce(Compiler(scope, params, on_type_error).predicate(st.where), F.lit(False)) if st.where is not None else F.lit(True)
    columns = []
    for f in node.df.schema:
        now = ref(alias, f.name)
        if f.name in values:
            new = values[f.name].col if values[f.name].type == f.dataType else values[f.name].col.try_cast(f.dataType)
            now = F.when(hit, new).otherwise(now)
        columns.append(now.alias(f.name))
    return graph.with_nodes(node.name, whole.select(*columns))


def _patched(graph: Graph, bindings: Bindings, alias: str, items: list[tuple[str, Value]]) -> Graph:
    """The graph with properties of the bound nodes set; the last binding and item win."""
    node = graph.type(bindings.types[alias].name)
    values = {prop: v for prop, v in items}
    rows = bindings.df.where(ref(alias, ID).isNotNull())
    order = F.struct(*(bindings.order() or [F.lit(0)]))
    patch = rows.groupBy(ref(alias, ID).alias("\x1fid")).agg(F.max_by(F.struct(*[v.col.alias(p) for p, v in values.items()]), order).alias("\x1fnew"))
    joined = node.df.withColumn("\x1fkey", node.id()).join(patch, F.col("\x1fkey") == F.col("\x1fid"), "left")
    columns = []
    for f in node.df.schema:
        old = F.col(f"`{f.name}`")
        if f.name in values:
            new = F.col(f"`\x1fnew`.`{f.name}`")
            new = new if values[f.name].type == f.dataType else new.try_cast(f.dataType)
            old = F.when(F.col("`\x1fnew`").isNotNull(), new).otherwise(old).alias(f.name)
        columns.append(old)
    return graph.with_nodes(node.name, joined.select(*columns))


def _refers(edge: EdgeType, node: NodeType) -> Column:
    return joined([F.col(f"`{c}`") for c in edge.src_cols]) if len(edge.src_cols) > 1 else F.col(f"`{edge.src_cols[0]}`")


def _deleted(graph: Graph, node: NodeType, alias: str, targets: DataFrame) -> tuple[Graph, list[DataFrame]]:
    """Nodes go; every edge to them is detached first (its foreign key becomes null)."""
    changes = []
    for edge in [e for e in graph.edges if e.dst == node.name]:
        if edge.dst_cols != node.key:
            raise MutationProblem(f"edge {edge.label} does not refer to the key of {node.name}")
        source = graph.type(edge.src)
        marked = source.df.withColumn("\x1fref", _refers(edge, node)).join(targets, F.col("\x1fref") == F.col("\x1fid"), "left")
        hit = marked.where(F.col("\x1fid").isNotNull())
        changes.append(hit.select(*_row(source.id(), None, edge.label, F.col("\x1fid"), F.lit(None), "detach")))
        columns = [F.when(F.col("\x1fid").isNull(), F.col(f"`{c}`")).alias(c) if c in edge.src_cols and c not in source.key else F.col(f"`{c}`") for c in source.df.columns]
        graph = graph.with_nodes(source.name, marked.select(*columns))
    changes.append(targets.select(*_row(F.col("\x1fid"), alias, None, F.lit(None), F.lit(None), "delete")))
    current = graph.type(node.name)
    kept = current.df.withColumn("\x1fkey", current.id()).join(targets, F.col("\x1fkey") == F.col("\x1fid"), "left_anti").drop("\x1fkey")
    return graph.with_nodes(node.name, kept), changes


def _created(graph: Graph, bindings: Bindings, item, compiler: Compiler) -> tuple[Graph, list[DataFrame], Bindings]:
    """CREATE and MERGE; bindings get the new alias, bound to the new or (MERGE) the found node."""
    owner = _node(bindings, item.into.alias)
    if item.type is None:
        raise MutationProblem("a new node needs a type")
    node = graph.type(item.type)
    edge = next((e for e in graph.edges if e.src == node.name and e.dst == owner.name and e.label == item.into.prop), None)
    if edge is None:
        raise MutationProblem(f"{owner.name} has no collection {item.into.prop} of {node.name}")
    props = dict(item.props)
    unknown = set(props) - set(node.props)
    if unknown:
        raise MutationProblem(f"{node.name} has no property {', '.join(sorted(unknown))}")
    values: dict[str, Column] = {}
    for f in node.df.schema:
        if f.name in props:
            values[f.name] = compiler.value(props[f.name]).col.cast(f.dataType)
        elif f.name in edge.src_cols:
            values[f.name] = ref(item.into.alias, edge.dst_cols[edge.src_cols.index(f.name)]).cast(f.dataType)
        elif f.name in node.key and f.dataType.simpleString() in ("int", "bigint"):
            top = node.df.agg(F.max(f"`{f.name}`")).first()[0] or 0
            # In binding order, so that a recomputed plan gives the same ids.
            values[f.name] = (F.lit(top) + F.row_number().over(Window.orderBy(*(bindings.order() or [ref(item.into.alias, ID)])))).cast(f.dataType)
        else:
            values[f.name] = F.lit(None).cast(f.dataType)
    missing = [c for c in edge.dst_cols if column(item.into.alias, c) not in bindings.df.columns]
    df = bindings.df
    if missing:
        keys = owner.df.select(owner.id().alias("\x1fowner"), *[F.col(f"`{c}`").alias(column(item.into.alias, c)) for c in missing])
        df = df.join(keys, ref(item.into.alias, ID) == F.col("\x1fowner")).drop("\x1fowner")
    df = df.select("*", *[v.alias(column(item.alias, p)) for p, v in values.items()])
    found = F.lit(False)
    if item.on is not None:
        # The first of the nodes that refer to the owner with an equal key.
        probe = df.select(*[ref(item.alias, c).alias(f"\x1f{c}") for c in dict.fromkeys((*edge.src_cols, item.on))]).distinct()
        wanted = [F.col(f"`{c}`") == F.col(f"`\x1f{c}`") for c in edge.src_cols] + [F.col(f"`{item.on}`").eqNullSafe(F.col(f"`\x1f{item.on}`"))]
        touched = node.df.join(probe, reduce(lambda x, y: x & y, wanted), "left_semi")
        seen = touched.groupBy(*[F.col(f"`{c}`").alias(f"\x1f{c}") for c in dict.fromkeys((*edge.src_cols, item.on))]).agg(F.min(F.struct(node.order(), F.struct(*[F.col(f"`{c}`") for c in node.df.columns]).alias("row"))).alias("\x1fold"))
        same = [ref(item.alias, c) == F.col(f"`\x1f{c}`") for c in edge.src_cols] + [ref(item.alias, item.on).eqNullSafe(F.col(f"`\x1f{item.on}`"))]
        df = df.join(seen, reduce(lambda x, y: x & y, same), "left")
        found = F.col("\x1fold").isNotNull()
        for p in values:
            df = df.withColumn(column(item.alias, p), F.when(found, F.col(f"`\x1fold`.row.`{p}`")).otherwise(ref(item.alias, p)))
    df = df.withColumn("\x1ffound", found).withColumn(column(item.alias, ID), _id_of(node, item.alias))
    fresh = df.where("not `\x1ffound`")
    if item.on is not None:
        # Within the statement, too, the first binding creates and later ones find.
        group = [ref(item.alias, c) for c in dict.fromkeys((*edge.src_cols, item.on))]
        order = bindings.order() or [ref(item.into.alias, ID)]
        fresh = fresh.withColumn("\x1frank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("`\x1frank` = 1")
    new_rows = fresh.select(*[ref(item.alias, p).alias(p) for p in values])
    operation = "merge" if item.on is not None else "create"
    changes = [
        fresh.select(*_row(ref(item.alias, ID), item.alias, None, F.lit(None), F.lit(None), operation)),
        fresh.select(*_row(ref(item.into.alias, ID), item.into.alias, item.into.prop, F.lit(None), ref(item.alias, ID), "attach")),
    ]
    types = {**bindings.types, item.alias: node}
    kept = [c for c in df.columns if not c.startswith("\x1f")]
    return graph.with_nodes(node.name, node.df.unionByName(new_rows)), changes, Bindings(df.select(*[F.col(f"`{c}`") for c in kept]), graph, types, bindings.optional)


def _id_of(node: NodeType, alias: str) -> Column:
    if len(node.key) == 1:
        return ref(alias, node.key[0])
    return joined([ref(alias, c) for c in (node.key or node.df.columns)])


def merge_probe(graph: Graph, type_name: str, rows: DataFrame, key: str) -> DataFrame:
    """Of candidate rows, those that a MERGE by `key` would create: the first of each new key."""
    node = graph.type(type_name)
    fresh = rows.join(node.df.select(F.col(f"`{key}`").alias("\x1fk")), F.col(f"`{key}`") == F.col("\x1fk"), "left_anti")
    return fresh.dropDuplicates([key])

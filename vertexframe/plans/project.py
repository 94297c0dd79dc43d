"""WITH, RETURN, GROUP BY, HAVING, DISTINCT, ORDER BY, OFFSET and LIMIT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindingProblem
from ..lang.ast import Aggregate, Item, Name, OrderKey, Path, Projection, Star, Statement
from .expr import Compiler, Scope, Value, printed, shown
from .match import ID, KIND, ORD, TYPE, Bindings, column, ref

#: Properties that a node's summary shows.
SHOWN = 8


class Rows(Scope):
    """Output rows: names are columns; a path means an output of that very name, or of that expression."""

    def __init__(self, df: DataFrame, items: tuple[Item, ...]):
        self.df, self.items = df, items

    def name(self, n: Name) -> Value:
        if n.name not in self.df.columns:
            return Value(F.lit(None), T.NullType())
        return Value(F.col(f"`{n.name}`"), self.df.schema[n.name].dataType)

    def path(self, p: Path) -> Value:
        for item in self.items:
            if item.expr == p or item.name == f"{p.alias}.{p.prop}":
                return self.name(Name(item.name))
        return Value(F.lit(None), T.NullType())


def summary(bindings: Bindings, alias: str) -> Column:
    """A node shown whole: id, kind, type and its first properties."""
    node = bindings.types[alias]
    props = [p for p in node.props if column(alias, p) in bindings.df.columns and p not in ("objectId", "kind", "type")][:SHOWN]
    fields = [ref(alias, ID).alias("objectId"), ref(alias, KIND).alias("kind"), ref(alias, TYPE).alias("type"), *[ref(alias, p).alias(p) for p in props]]
    return F.when(ref(alias, ID).isNotNull(), F.struct(*fields))


def sort_column(v: Value, descending: bool) -> Column:
    """Missing values sort as the empty string: before all others, or after them if descending."""
    c = v.col
    if v.kind == "string":
        c = F.collate(F.coalesce(printed(v), F.lit("")), "UNICODE")
    elif v.kind == "other":
        c = F.to_json(c)
    return c.desc_nulls_last() if descending else c.asc_nulls_first()


def _number(v: Value) -> Column:
    """What sum and avg add up: finite numbers, and text that reads as one."""
    if v.kind == "number":
        return F.when(~F.isnan(v.col) & (F.abs(v.col) < float("inf")), v.col.cast("double")) if v.fractional else v.col.cast("double")
    if v.kind == "boolean":
        return v.col.cast("double")
    if v.kind == "null":
        return F.lit(None).cast("double")
    text = F.trim(printed(v))
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def aggregate(agg: Aggregate, scope: Bindings) -> Column:
    if agg.arg is None:
        return F.count(F.lit(1))
    if agg.fn == "count" and isinstance(agg.arg, Name):
        found = ref(agg.arg.name, ID)
        return F.count_distinct(found) if agg.distinct else F.count(found)
    v = scope.path(agg.arg)
    if agg.fn == "count":
        return F.count_distinct(v.col) if agg.distinct else F.count(v.col)
    if agg.fn == "sum":
        return F.coalesce(F.sum(_number(v)), F.lit(0.0))
    if agg.fn == "avg":
        return F.avg(_number(v))
    pick = F.min if agg.fn == "min" else F.max
    if v.kind == "string":
        return pick(F.collate(printed(v), "UNICODE")).cast("string")
    return pick(v.col)


def is_aggregate(p: Projection) -> bool:
    return bool(p.group) or any(isinstance(i.expr, Aggregate) for i in p.items)


def _unique(items: list[Item]) -> list[Item]:
    """A later output of the same name replaces an earlier one."""
    return list({i.name: i for i in items}.values())


def project(bindings: Bindings, p: Projection, params: dict, on_type_error: str, hidden: list[Column]) -> tuple[DataFrame, tuple[Item, ...]]:
    """Output rows of a projection over bindings (with the `hidden` columns too, if nothing is grouped)."""
    compiler = Compiler(bindings, params, on_type_error)
    if not is_aggregate(p):
        items, columns = _unique(list(p.items)), []
        for i in items:
            if isinstance(i.expr, Star):
                c = F.struct(*[summary(bindings, a).alias(a) for a in bindings.types])
            elif isinstance(i.expr, Name) and i.expr.name in bindings.types:
                c = summary(bindings, i.expr.name)
            else:
                c = shown(compiler.value(i.expr))
            columns.append(c.alias(i.name))
        return bindings.df.select(*columns, *hidden), tuple(items)
    items = _unique([i for i in p.items if not isinstance(i.expr, Star) and not (isinstance(i.expr, Name) and i.expr.name in bindings.types)])
    keys = {}
    for k, g in enumerate(p.group):
        v = bindings.path(g)
        col = F.when(~F.isnan(v.col), v.col) if v.fractional else shown(v)
        keys[g] = (f"\x1fkey{k}", F.lit(None).cast("string") if v.kind == "null" else col)
    order = bindings.order()
    aggregates, out = [], []
    for k, i in enumerate(items):
        if isinstance(i.expr, Aggregate):
            aggregates.append(aggregate(i.expr, bindings).alias(f"\x1fout{k}"))
            out.append(F.col(f"`\x1fout{k}`").alias(i.name))
        elif i.expr in keys:
            out.append(F.col(f"`{keys[i.expr][0]}`").alias(i.name))
        else:
            v = compiler.value(i.expr)
            first = F.min_by(shown(v), F.struct(*order)) if order and v.kind != "null" else F.first(shown(v))
            aggregates.append(first.alias(f"\x1fout{k}"))
            out.append(F.col(f"`\x1fout{k}`").alias(i.name))
    if not aggregates:
        aggregates = [F.count(F.lit(1)).alias("\x1fn")]
    grouped = bindings.df.groupBy(*[c.alias(n) for n, c in keys.values()]) if keys else bindings.df
    return grouped.agg(*aggregates).select(*out), tuple(items)


def needs_order(st: Statement) -> bool:
    """Whether the order of bindings can show: pages, and outputs that are neither grouped nor aggregated."""
    first = st.with_ or st.returns
    if is_aggregate(first):
        return any(not isinstance(i.expr, (Aggregate, Star)) and i.expr not in first.group for i in first.items)
    return st.limit is not None or st.offset is not None


def page(df: DataFrame, st: Statement) -> DataFrame:
    if st.offset:
        df = df.offset(st.offset)
    return df if st.limit is None else df.limit(st.limit)


def sorted_bindings(bindings: Bindings, st: Statement) -> list[Column] | None:
    """ORDER BY over bindings, if all its keys are paths; with the default order to break ties on pages."""
    if any(not isinstance(k.expr, Path) for k in st.order):
        return None
    keys = [sort_column(bindings.path(k.expr), k.descending) for k in st.order]
    paged = st.limit is not None or st.offset is not None
    return keys + (bindings.order() if paged or not keys else [])


def finish(bindings: Bindings, st: Statement, params: dict, on_type_error: str) -> DataFrame:
    """All that follows WHERE in a query."""
    paged = st.limit is not None or st.offset is not None
    first = st.with_ or st.returns
    plain = st.with_ is None and not is_aggregate(first) and first.having is None and not first.distinct
    if plain and (st.order or paged):
        keys = sorted_bindings(bindings, st)
        if keys is not None:
            ordered = bindings.df.orderBy(*keys) if keys else bindings.df
            held = Bindings(page(ordered, st), bindings.graph, bindings.types, bindings.optional)
            return project(held, first, params, on_type_error, [])[0]
    hidden = []
    carry = paged and not is_aggregate(first)
    if carry:
        hidden = [F.struct(*bindings.order()).alias(ORD)]
    rows, items = project(bindings, first, params, on_type_error, hidden)
    rows = _filter(rows, items, first.having, params, on_type_error)
    if first.distinct:
        rows = _distinct(rows, carry)
    if st.with_ is not None:
        rows = _filter(rows, items, first.where, params, on_type_error)
        rows, items = _rename(rows, items, st.returns, carry)
        if st.returns.distinct:
            rows = _distinct(rows, carry)
        rows = _filter(rows, items, st.returns.having, params, on_type_error)
    if st.order or paged:
        scope = Rows(rows, items)
        values = [(scope.path(k.expr) if isinstance(k.expr, Path) else scope.name(k.expr), k.descending) for k in st.order]
        keys = [sort_column(v, d) for v, d in values if v.kind != "null"]
        if carry:
            keys.append(F.col(f"`{ORD}`"))
        if keys:
            rows = rows.orderBy(*keys)
        rows = page(rows, st)
    return rows.drop(ORD) if carry else rows


def _filter(rows: DataFrame, items: tuple[Item, ...], condition, params: dict, on_type_error: str) -> DataFrame:
    return rows if condition is None else rows.where(Compiler(Rows(rows, items), params, on_type_error).predicate(condition))


def _distinct(rows: DataFrame, carry: bool) -> DataFrame:
    if not carry:
        return rows.distinct()
    names = [c for c in rows.columns if c != ORD]
    return rows.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.min(F.col(f"`{ORD}`")).alias(ORD))


def _rename(rows: DataFrame, items: tuple[Item, ...], returns: Projection, carry: bool) -> tuple[DataFrame, tuple[Item, ...]]:
    names, columns, out = [c for c in rows.columns if c != ORD], [], []
    for i in returns.items:
        if isinstance(i.expr, Star):
            columns.append(F.struct(*[F.col(f"`{n}`") for n in names]).alias(i.name))
        elif isinstance(i.expr, Name) and i.expr.name in names:
            columns.append(F.col(f"`{i.expr.name}`").alias(i.name))
        else:
            raise BindingProblem("RETURN after WITH takes the names that WITH gives")
        out.append(i)
    return rows.select(*columns, *([F.col(f"`{ORD}`")] if carry else [])), tuple(out)

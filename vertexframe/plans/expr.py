"""Expressions and predicates of the query language as Spark columns.

Logic is two-valued.  A predicate is compiled either `strict` (never null, needed under NOT and wherever
its value is returned) or not (null stands for false, which a filter, AND, OR and WHEN treat alike; these
forms reach the Parquet scan).  Missing values compare as the empty string.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BindingProblem
from ..lang.ast import And, Arith, Call, Case, Compare, ListOf, Literal, Name, Not, Or, Param, Path

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_BLANKS = r"^[\s ﻿]+|[\s ﻿]+$"


#: An instant as times print: years of four digits, milliseconds, UTC.
_INSTANT = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z")


@dataclass(frozen=True)
class Value:
    """A column and what is known of it.  bound: the alias whose presence tells null from missing."""

    col: Column
    type: T.DataType
    literal: bool = False
    value: object = None
    bound: Column | None = None

    @property
    def kind(self) -> str:
        t = self.type
        if isinstance(t, (*_INTEGERS, T.FloatType, T.DoubleType, T.DecimalType)):
            return "number"
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, (T.StringType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BinaryType)):
            return "string"
        return "other"

    @property
    def fractional(self) -> bool:
        return isinstance(self.type, (T.FloatType, T.DoubleType))


def literal(value: object) -> Value:
    if value is None:
        return Value(F.lit(None), T.NullType(), True, None)
    if isinstance(value, (datetime, date)):
        value = value.strftime("%Y-%m-%dT%H:%M:%S.") + f"{getattr(value, 'microsecond', 0) // 1000:03d}Z"
    kinds = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType()))
    for python, spark in kinds:
        if isinstance(value, python):
            return Value(F.lit(value), spark, True, value)
    if isinstance(value, Decimal):
        return Value(F.lit(value), T.DecimalType(38, 0), True, value)
    if isinstance(value, (list, tuple)):
        return Value(F.lit(None), T.ArrayType(T.NullType()), True, list(value))
    raise BindingProblem(f"a {type(value).__name__} cannot be used in a query")


def text_of(v: Value) -> Column:
    """The string form of a value, null as the empty string; numbers print without a trailing .0."""
    if v.kind == "null":
        return F.lit("")
    return F.coalesce(printed(v), F.lit(""))


def printed(v: Value) -> Column:
    c = v.col
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(v.type, T.BinaryType):
        return F.base64(c)
    if v.fractional:
        d = c.cast("double")
        return (
            F.when(F.isnan(d), "NaN").when(d == float("inf"), "Infinity").when(d == float("-inf"), "-Infinity")
            .when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string"))
            .otherwise(d.cast("string"))
        )
    if v.kind == "other":
        return F.to_json(c)
    return c.cast("string")


def shown(v: Value) -> Column:
    """The value as a query returns it: times as ISO text, bytes as Base64."""
    return printed(v) if isinstance(v.type, (T.TimestampType, T.TimestampNTZType, T.BinaryType)) else v.col


class Scope:
    """Resolves paths and names; see plans.match and plans.project."""

    def path(self, p: Path) -> Value:
        raise BindingProblem(f"{p.alias}.{p.prop} is not known here")

    def name(self, n: Name) -> Value:
        raise BindingProblem(f"{n.name} is not known here")


class Compiler:
    def __init__(self, scope: Scope, params: dict | None = None, on_type_error: str = "raise"):
        self.scope, self.params, self.on_type_error = scope, params or {}, on_type_error

    # -- values --------------------------------------------------------------------------------------
    def value(self, e) -> Value:
        if isinstance(e, Literal):
            return literal(e.value)
        if isinstance(e, Param):
            return literal(self.params.get(e.name))
        if isinstance(e, ListOf):
            return literal([self.constant(x) for x in e.items])
        if isinstance(e, Path):
            return self.scope.path(e)
        if isinstance(e, Name):
            return self.scope.name(e)
        if isinstance(e, Arith):
            return self.arith(e)
        if isinstance(e, Call):
            return self.call(e)
        if isinstance(e, Case):
            return self.case(e)
        raise BindingProblem(f"{type(e).__name__} is not a value")

    def constant(self, e):
        v = self.value(e)
        if not v.literal:
            raise BindingProblem("lists hold literals and parameters only")
        return v.value

    def arith(self, e: Arith) -> Value:
        left, right = self.value(e.left), self.value(e.right)
        for side in (left, right):
            if side.kind not in ("number", "null") or (side.literal and side.value is None):
                if self.on_type_error == "null":
                    return Value(F.lit(None).cast("double"), T.DoubleType())
                raise BindingProblem(f"{e.op} needs numbers")
        a, b = left.col.cast("double"), right.col.cast("double")
        if e.op == "/":
            zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).otherwise(float("-inf"))
            out = F.when(b == 0, zero).otherwise(F.try_divide(a, b))
        else:
            out = a + b if e.op == "+" else a - b if e.op == "-" else a * b
        if self.on_type_error == "raise":
            checked = [s.col.isNull() for s in (left, right) if not s.literal and not getattr(s, "sure", False)]
            if checked:
                wrong = checked[0] if len(checked) == 1 else checked[0] | checked[1]
                out = F.when(wrong, F.raise_error(F.lit(f"{e.op} needs numbers")).cast("double")).otherwise(out)
        return Value(out, T.DoubleType())

    def call(self, e: Call) -> Value:
        args = [self.value(a) for a in e.args]
        first = args[0]
        if e.fn == "coalesce":
            typed = [a for a in args if a.kind != "null"]
            if not typed:
                return literal(None)
            return self._same_type(typed, lambda cols: F.coalesce(*cols))
        if first.kind == "null":
            return literal(None)
        if e.fn == "length":
            if isinstance(first.type, T.ArrayType):
                return Value(F.size(first.col), T.IntegerType())
            # UTF-16 units: one more for each character beyond the basic plane.
            text = printed(first)
            return Value((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long"), T.LongType())
        text = printed(first)
        out = {"lower": F.lower, "upper": F.upper, "trim": lambda c: F.regexp_replace(c, _BLANKS, "")}[e.fn](text)
        return Value(out, T.StringType())

    def _same_type(self, values: list[Value], make) -> Value:
        kinds = {v.kind for v in values}
        if kinds == {"number"}:
            if all(isinstance(v.type, _INTEGERS) for v in values):
                widest = next((v for v in values if not v.literal), values[0])
                wide = T.LongType() if any(isinstance(v.type, T.LongType) for v in values if not v.literal) else widest.type
                return Value(make([v.col.cast(wide) for v in values]), wide)
            return Value(make([v.col.cast("double") for v in values]), T.DoubleType())
        if len(kinds) == 1 and "string" not in kinds:
            return Value(make([v.col for v in values]), values[0].type)
        return Value(make([printed(v) for v in values]), T.StringType())

    def case(self, e: Case) -> Value:
        conditions = [self.predicate(c) for c, _ in e.whens]
        values = [self.value(v) for _, v in e.whens]
        last = self.value(e.otherwise) if e.otherwise is not None else literal(None)
        typed = [v for v in (*values, last) if v.kind != "null"]
        if not typed:
            return literal(None)

        def make(cols: list[Column]) -> Column:
            left = list(cols)
            out = None
            for condition, v in zip(conditions, values):
                col = left.pop(0) if v.kind != "null" else F.lit(None)
                out = F.when(condition, col) if out is None else out.when(condition, col)
            return out.otherwise(left.pop(0)) if last.kind != "null" else out

        return self._same_type(typed, make)

    # -- predicates ------------------------------------------------------------------------------------
    def predicate(self, e, strict: bool = False) -> Column:
        if isinstance(e, And):
            out = self.predicate(e.parts[0], strict)
            for p in e.parts[1:]:
                out = out & self.predicate(p, strict)
            return out
        if isinstance(e, Or):
            out = self.predicate(e.parts[0], strict)
            for p in e.parts[1:]:
                out = out | self.predicate(p, strict)
            return out
        if isinstance(e, Not):
            return ~self.predicate(e.part, True)
        if isinstance(e, Compare):
            return self.compare(e, strict)
        raise BindingProblem("a condition is expected")

    def compare(self, e: Compare, strict: bool) -> Column:
        left = self.value(e.left)
        if e.op == "IS NULL":
            return left.col.isNull()
        if e.op == "IS NOT NULL":
            return left.col.isNotNull()
        right = self.value(e.right)
        if e.op == "=":
            return self.equal(left, right, strict)
        if e.op == "!=":
            return ~self.equal(left, right, True)
        if e.op == "IN":
            return self.member(left, right, strict)
        if e.op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
            test = {"CONTAINS": F.contains, "STARTS WITH": F.startswith, "ENDS WITH": F.endswith}[e.op]
            if right.literal and right.kind == "string" and right.value and left.kind == "string" and not strict:
                return test(printed(left), F.lit(right.value))
            return test(text_of(left), text_of(right))
        return self.ordered(e.op, left, right, strict)

    def equal(self, a: Value, b: Value, strict: bool) -> Column:
        if "null" in (a.kind, b.kind):
            if a.kind == b.kind:
                return F.lit(True)
            v = b if a.kind == "null" else a
            # A null of a bound node is null; of an unbound one it is missing, which equals no null.
            return v.col.isNull() if v.bound is None else v.col.isNull() & v.bound.isNotNull()
        if a.kind != b.kind or a.kind == "other":
            return F.lit(False) if a.kind != "other" or b.kind != "other" else a.col.eqNullSafe(b.col)
        by_time = self._by_time("=", a, b, strict)
        if by_time is not None:
            return by_time
        x, y = self._alike(a, b)
        if a.literal or b.literal:
            out = x.eqNullSafe(y) if strict else x == y
        else:
            out = x.eqNullSafe(y)
        for v in (a, b):
            if v.fractional and not v.literal:
                out = out & F.coalesce(~F.isnan(v.col), F.lit(True)) if not (a.literal or b.literal) else out
        return out

    def _alike(self, a: Value, b: Value) -> tuple[Column, Column]:
        """Columns that Spark compares as they are; times as times if the other side is a full instant."""
        times = (T.TimestampType, T.TimestampNTZType)
        if isinstance(a.type, times) and type(a.type) is type(b.type):
            return a.col, b.col
        if a.kind == "string" and not (isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType)):
            return printed(a), printed(b)
        return a.col, b.col

    def member(self, a: Value, b: Value, strict: bool) -> Column:
        if not (b.literal and isinstance(b.value, list)):
            return F.lit(False)
        like = {"number": (int, float, Decimal), "string": (str,), "boolean": (bool,)}.get(a.kind, ())
        items = [x for x in b.value if isinstance(x, like) and (a.kind == "boolean" or not isinstance(x, bool))]
        col = printed(a) if a.kind == "string" else a.col
        out = col.isin(items) if items else F.lit(False)
        if strict and items:
            out = F.coalesce(out, F.lit(False))
        if any(x is None for x in b.value):
            out = out | (a.col.isNull() if a.bound is None else a.col.isNull() & a.bound.isNotNull())
        return out

    def ordered(self, op: str, a: Value, b: Value, strict: bool) -> Column:
        if a.kind == "number" and b.kind == "number":
            return self._numeric(op, a, b, strict)
        by_time = self._by_time(op, a, b, strict)
        if by_time is not None:
            return by_time
        x, y = F.collate(text_of(a), "UNICODE"), F.collate(text_of(b), "UNICODE")
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def _by_time(self, op: str, a: Value, b: Value, strict: bool) -> Column | None:
        """A time against a full instant as text, compared as times, which scans can filter by; None: not of this form.

        Instants print with milliseconds, so all printed alike stand for the same millisecond.
        """
        if a.literal:
            return self._by_time({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a, strict) if not b.literal else None
        kinds = {T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp_ntz"}
        if type(a.type) not in kinds or not (b.literal and isinstance(b.value, str) and _INSTANT.fullmatch(b.value)):
            return None
        try:
            begin = datetime.fromisoformat(b.value[:-1])
            end = begin + timedelta(milliseconds=1)
        except (ValueError, OverflowError):
            return None
        x, y = (F.lit(t.isoformat(" ")).cast(kinds[type(a.type)]) for t in (begin, end))
        if op == "=":
            out = (a.col >= x) & (a.col < y)
        else:
            # A missing value compares as the empty string, which is below every instant.
            out = {"<": lambda: (a.col < x) | a.col.isNull(), "<=": lambda: (a.col < y) | a.col.isNull(), ">": lambda: a.col >= y, ">=": lambda: a.col >= x}[op]()
        return F.coalesce(out, F.lit(False)) if strict else out

    def _numeric(self, op: str, a: Value, b: Value, strict: bool) -> Column:
        x, y = a.col, b.col
        out = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        # NaN is the largest double in Spark and compares with nothing here.
        top = a if op in (">", ">=") else b
        if top.fractional and not top.literal:
            out = out & ~F.isnan(top.col)
        # A missing value compares as the empty string, which is below every number.
        less = op in ("<", "<=")
        small, large = (a, b) if less else (b, a)
        if not small.literal:
            missing = small.col.isNull() if op in ("<=", ">=") or large.literal else small.col.isNull() & large.col.isNotNull()
            out = out | missing
        return F.coalesce(out, F.lit(False)) if strict else out

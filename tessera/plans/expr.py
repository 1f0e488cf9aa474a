"""Expressions to typed Columns."""

from __future__ import annotations

import datetime
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.cypher import ast as A
from tessera.errors import BindError
from tessera.functions import scalar
from tessera.functions.aggregate import NAMES as AGGREGATES
from tessera.functions.scalar import BOOL, DOUBLE, LONG, STRING, Typed
from tessera.plans.scope import Frame, col
from tessera.types import common_type, is_null, is_number


def literal(value: Any) -> Typed:
    if value is None:
        return Typed(F.lit(None), T.NullType())
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOL)
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), LONG)
    if isinstance(value, float):
        return Typed(F.lit(value), DOUBLE)
    if isinstance(value, str):
        return Typed(F.lit(value), STRING)
    if isinstance(value, datetime.datetime):
        return Typed(F.lit(value).cast("timestamp_ntz"), T.TimestampNTZType())
    if isinstance(value, datetime.date):
        return Typed(F.lit(value), T.DateType())
    if isinstance(value, (list, tuple)):
        return listed([literal(v) for v in value])
    raise BindError(f"a parameter can't be of type {type(value).__name__}")


def listed(items: list[Typed]) -> Typed:
    t = common_type([x.type for x in items])
    if t is None:
        raise BindError("a list's items need one type")
    t = LONG if is_null(t) else t
    return Typed(F.array(*[x.col.cast(t) for x in items]).cast(T.ArrayType(t)), T.ArrayType(t))


class Compiler:
    """Compiles against a frame; functions: the user's own builders by name."""

    def __init__(self, frame: Frame | None, params: dict[str, Any], functions: dict[str, Any], local: dict[str, Typed] | None = None):
        self.frame, self.params, self.functions, self.local = frame, params, functions, local or {}

    def typed(self, e: Any) -> Typed:
        return getattr(self, f"_{type(e).__name__.lower()}")(e)

    def predicate(self, e: Any):
        """A filter's Column: anything but a boolean counts as not true."""
        x = self.typed(e)
        return x.col if isinstance(x.type, T.BooleanType) else F.lit(None).cast("boolean")

    def _column(self, name: str) -> Typed:
        field = self.frame.df.schema[name]
        return Typed(col(name), field.dataType)

    def _lit(self, e: A.Lit) -> Typed:
        return literal(e.value)

    def _param(self, e: A.Param) -> Typed:
        return literal(self.params.get(e.name))

    def _var(self, e: A.Var) -> Typed:
        if e.name in self.local:
            return self.local[e.name]
        if self.frame is None or e.name not in self.frame.scope:
            raise BindError(f"undefined variable '{e.name}'")
        found = self._column(e.name)
        return Typed(found.col, found.type, self.frame.scope[e.name].path)

    def _prop(self, e: A.Prop) -> Typed:
        if not isinstance(e.base, A.Var):
            raise BindError("properties are one level deep")
        var = e.base.name
        if self.frame is None or var not in self.frame.scope:
            raise BindError(f"undefined variable '{var}'")
        if f"{var}.{e.name}" not in self.frame.df.columns:
            raise BindError(f"unknown property '{e.name}' of '{var}'")
        return self._column(f"{var}.{e.name}")

    def _listof(self, e: A.ListOf) -> Typed:
        return listed([self.typed(x) for x in e.items])

    def _comprehension(self, e: A.Comprehension) -> Typed:
        source = self.typed(e.source)
        if not isinstance(source.type, T.ArrayType):
            if is_null(source.type):
                return Typed(source.col.cast(T.ArrayType(LONG)), T.ArrayType(LONG))
            raise BindError("a comprehension needs a list")
        item = source.type.elementType
        seen: list[T.DataType] = []

        def inner(x):
            return Compiler(self.frame, self.params, self.functions, {**self.local, e.var: Typed(x, item)})

        def result(x):
            out = inner(x).typed(e.result)
            t = LONG if is_null(out.type) else out.type
            seen.append(t)
            return out.col.cast(t)

        kept = source.col if e.where is None else F.filter(source.col, lambda x: F.coalesce(inner(x).predicate(e.where), F.lit(False)))
        mapped = F.transform(kept, result)
        return Typed(mapped, T.ArrayType(seen[0]))

    def _unary(self, e: A.Unary) -> Typed:
        x = self.typed(e.operand)
        if e.op == "NOT":
            return Typed(~x.cast(BOOL).col, BOOL) if isinstance(x.type, (T.BooleanType, T.NullType)) else Typed(F.lit(None).cast("boolean"), BOOL)
        return Typed(-x.col, x.type) if is_number(x.type) else Typed(F.lit(None), T.NullType())

    def _binary(self, e: A.Binary) -> Typed:
        a, b = self.typed(e.left), self.typed(e.right)
        if e.op in ("AND", "OR"):
            a, b = (x.cast(BOOL).col if isinstance(x.type, (T.BooleanType, T.NullType)) else F.lit(None).cast("boolean") for x in (a, b))
            return Typed(a & b if e.op == "AND" else a | b, BOOL)
        if e.op == "=~":
            for x in (a, b):
                if not isinstance(x.type, (T.StringType, T.NullType)):
                    raise BindError("=~ takes strings")
            return Typed(F.call_function("rlike", a.cast(STRING).col, b.cast(STRING).col), BOOL)
        return self._compare(e.op, a, b) if e.op in ("=", "<>", "<", "<=", ">", ">=") else self._arithmetic(e.op, a, b)

    @staticmethod
    def _compare(op: str, a: Typed, b: Typed) -> Typed:
        t = common_type([a.type, b.type])
        if t is None:  # values of unlike types: never equal, never in order, unknown against NULL
            return Typed(F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(op == "<>")), BOOL)
        x, y = (v.col if v.type == t or is_null(t) else v.col.cast(t) for v in (a, b))
        if is_null(t):
            return Typed(F.lit(None).cast("boolean"), BOOL)
        if isinstance(t, T.ArrayType) and op not in ("=", "<>"):
            return Typed(F.when(x.isNotNull() & y.isNotNull(), F.lit(False)), BOOL)
        made = {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
        if isinstance(t, T.DoubleType):  # NaN equals nothing and has no order
            nan = F.isnan(x) | F.isnan(y)
            made = F.when(nan, F.lit(op == "<>")).otherwise(made)
        return Typed(made, BOOL)

    @staticmethod
    def _arithmetic(op: str, a: Typed, b: Typed) -> Typed:
        if op == "+" and (isinstance(a.type, T.StringType) and isinstance(b.type, (T.StringType, T.NullType)) or isinstance(b.type, T.StringType) and is_null(a.type)):
            return Typed(F.concat(a.cast(STRING).col, b.cast(STRING).col), STRING)
        if not (is_number(a.type) and is_number(b.type)):
            return Typed(F.lit(None), T.NullType())
        whole = isinstance(a.type, T.LongType) and isinstance(b.type, T.LongType)
        t = LONG if whole else DOUBLE
        x, y = a.col.cast(t), b.col.cast(t)
        if op == "/":
            return Typed(F.call_function("div", x, y).cast("bigint") if whole else x / y, t)
        if op == "%":
            return Typed(x % y, LONG) if whole else Typed(F.lit(None), T.NullType())
        return Typed({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), t)

    def _isnull(self, e: A.IsNull) -> Typed:
        c = self.typed(e.operand).col
        return Typed(c.isNotNull() if e.negated else c.isNull(), BOOL)

    def _in(self, e: A.In) -> Typed:
        """Two-valued: a NULL is in no list."""
        x, items = self.typed(e.operand), self.typed(e.items)
        if is_null(items.type):
            return Typed(F.lit(None).cast("boolean"), BOOL)
        if not isinstance(items.type, T.ArrayType):
            raise BindError("IN takes a list")
        t = common_type([x.type, items.type.elementType])
        if t is None or is_null(x.type):
            found = F.lit(False)
        elif isinstance(e.items, A.ListOf) and all(isinstance(i, A.Lit) for i in e.items.items):
            found = F.coalesce(x.col.cast(t).isin([F.lit(i.value).cast(t) for i in e.items.items if i.value is not None]), F.lit(False))
        else:
            found = F.coalesce(F.exists(items.col.cast(T.ArrayType(t)), lambda y: F.coalesce(y == x.col.cast(t), F.lit(False))), F.lit(False))
        made = ~found if e.negated else found
        return Typed(F.when(items.col.isNotNull(), made), BOOL)

    def _case(self, e: A.Case) -> Typed:
        subject = self.typed(e.subject) if e.subject is not None else None
        results = [self.typed(r) for _, r in e.whens] + ([self.typed(e.default)] if e.default is not None else [])
        t = common_type([r.type for r in results])
        if t is None:
            raise BindError("CASE branches need one type")
        out = F
        for (test, _), r in zip(e.whens, results):
            hit = self.predicate(test) if subject is None else self._compare("=", subject, self.typed(test)).col
            out = out.when(hit, r.col.cast(t))
        return Typed(out.otherwise(results[-1].col.cast(t)) if e.default is not None else out, t)

    def _cast(self, e: A.Cast) -> Typed:
        return scalar.cast(self.typed(e.operand), e.to)

    def _call(self, e: A.Call) -> Typed:
        if e.name in AGGREGATES:
            raise BindError(f"{e.name}() is allowed in RETURN and WITH only")
        args = [self.typed(a) for a in e.args]
        if e.name in self.functions:
            made = self.functions[e.name](*[a.col for a in args])
            kind = self.frame.df.select(made.alias("x")).schema["x"].dataType if self.frame else STRING
            return Typed(made, kind)
        return scalar.apply(e.name, args)

    def _exists(self, e: A.Exists) -> Typed:
        raise BindError("EXISTS is allowed in WHERE, RETURN and WITH of a pattern's query only")


def constant(e: Any, params: dict[str, Any]) -> Any:
    """The Python value of a literal, a parameter or a negated number."""
    if isinstance(e, A.Lit):
        return e.value
    if isinstance(e, A.Param):
        if e.name not in params:
            raise BindError(f"missing parameter '{e.name}'")
        return params[e.name]
    if isinstance(e, A.Unary) and e.op == "-":
        return -constant(e.operand, params)
    raise BindError("expected a literal or a parameter")

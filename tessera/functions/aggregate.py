"""Aggregates: count, sum, avg, min, max, collect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import BindError
from tessera.functions.scalar import DOUBLE, LONG, Typed
from tessera.types import is_null, is_number

NAMES = {"count", "sum", "avg", "min", "max", "collect"}


def aggregate(name: str, arg: Typed | None, distinct: bool) -> Typed:
    """arg None: count of rows. NULLs are skipped; sum and avg of nothing are NULL, collect of nothing is []."""
    if arg is None:
        if name != "count":
            raise BindError(f"{name}(*) is not defined")
        return Typed(F.count(F.lit(1)), LONG)
    c: Column = arg.col
    if name == "count":
        return Typed(F.count_distinct(c) if distinct else F.count(c), LONG)
    if name == "collect":
        item = LONG if is_null(arg.type) else arg.type
        c = c.cast(item)
        return Typed(F.collect_set(c) if distinct else F.collect_list(c), T.ArrayType(item))
    if name in ("min", "max"):
        return Typed(F.min(c) if name == "min" else F.max(c), arg.type)
    if not (is_number(arg.type) or is_null(arg.type)):
        raise BindError(f"{name}() takes numbers")
    if is_null(arg.type):
        c = c.cast(LONG)
    if name == "sum":
        return Typed(F.sum_distinct(c) if distinct else F.sum(c), LONG if is_null(arg.type) else arg.type)
    return Typed(F.avg(c) if not distinct else F.try_divide(F.sum_distinct(c).cast("double"), F.count_distinct(c)), DOUBLE)

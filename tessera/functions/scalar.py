"""Scalar functions: each maps typed arguments to a Column made of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import BindError
from tessera.types import common_type, display, is_null, is_number

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


@dataclass(frozen=True)
class Typed:
    """An expression's Column, its type, and whether the value is a path."""

    col: Column
    type: T.DataType
    path: bool = False

    def cast(self, t: T.DataType) -> Typed:
        return self if self.type == t else Typed(self.col.cast(t), t, self.path)


Builder = Callable[..., Typed]
REGISTRY: dict[str, tuple[int, int | None, Builder]] = {}


def function(name: str, least: int, most: int | None = -1):
    """Register a builder under a lower-case name with its range of argument counts (most None: any)."""

    def put(build: Builder) -> Builder:
        REGISTRY[name] = (least, least if most == -1 else most, build)
        return build

    return put


def apply(name: str, args: list[Typed]) -> Typed:
    if name not in REGISTRY:
        raise BindError(f"unknown function '{name}'")
    least, most, build = REGISTRY[name]
    if len(args) < least or (most is not None and len(args) > most):
        raise BindError(f"{name}() takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, got {len(args)}")
    return build(*args)


def _text(x: Typed, name: str) -> Column:
    if not (is_null(x.type) or isinstance(x.type, T.StringType)):
        raise BindError(f"{name}() takes a string")
    return x.cast(STRING).col


def _number(x: Typed, name: str) -> Typed:
    if is_null(x.type):
        return x.cast(DOUBLE)
    if not is_number(x.type):
        raise BindError(f"{name}() takes a number")
    return x


def _int(x: Typed, name: str) -> Column:
    if not (is_null(x.type) or isinstance(x.type, T.LongType)):
        raise BindError(f"{name}() takes an integer")
    return x.cast(LONG).col


def _list(x: Typed, name: str) -> Typed:
    if is_null(x.type):
        return Typed(x.col.cast(T.ArrayType(LONG)), T.ArrayType(LONG))
    if not isinstance(x.type, T.ArrayType):
        raise BindError(f"{name}() takes a list")
    return x


def _with_item(lst: Typed, item: Typed, name: str) -> tuple[Column, Column, T.ArrayType]:
    """The list and the item cast to one element type."""
    lst = _list(lst, name)
    inner = common_type([lst.type.elementType, item.type])
    if inner is None:
        raise BindError(f"{name}(): the item's type differs from the list's")
    inner = LONG if is_null(inner) else inner
    return lst.col.cast(T.ArrayType(inner)), item.col.cast(inner), T.ArrayType(inner)


def _simple(names: dict[str, Callable[[Column], Column]], result: T.DataType) -> None:
    for name, build in names.items():
        function(name, 1)(lambda s, n=name, f=build: Typed(f(_text(s, n)), result))


_simple(
    {
        "lower": F.lower,
        "upper": F.upper,
        "trim": lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""),
        "ltrim": lambda s: F.regexp_replace(s, r"(?U)^\s+", ""),
        "rtrim": lambda s: F.regexp_replace(s, r"(?U)\s+$", ""),
        "reverse": F.reverse,
    },
    STRING,
)
for _name, _test in {"contains": F.contains, "starts_with": F.startswith, "ends_with": F.endswith}.items():
    function(_name, 2)(lambda s, t, n=_name, f=_test: Typed(f(_text(s, n), _text(t, n)), BOOL))


@function("length", 1)
def length(x: Typed) -> Typed:
    """Bytes of a string, items of a list, relationships of a path."""
    if isinstance(x.type, T.ArrayType):
        n = F.when(x.col.isNotNull(), F.size(x.col).cast("bigint"))
        return Typed(F.greatest(n - 1, F.lit(0)) if x.path else n, LONG)
    return Typed(F.octet_length(_text(x, "length")).cast("bigint"), LONG)


REGISTRY["size"] = REGISTRY["length"]


def text_of(x: Typed) -> Column:
    return display(x.col, x.type)


@function("concat", 0, None)
def concat(*args: Typed) -> Typed:
    return Typed(F.concat_ws("", F.lit(""), *[text_of(a) for a in args]), STRING)


@function("to_string", 1)
def to_string(x: Typed) -> Typed:
    return Typed(F.coalesce(text_of(x), F.lit("NULL")), STRING)


@function("coalesce", 1, None)
def coalesce(*args: Typed) -> Typed:
    t = common_type([a.type for a in args])
    if t is None:
        raise BindError("coalesce() takes values of one type")
    return Typed(F.coalesce(*[a.col.cast(t) for a in args]), t)


@function("substring", 2, 3)
def substring(s: Typed, start: Typed, n: Typed | None = None) -> Typed:
    """From a 0-based start; negatives count as 0."""
    text, at = _text(s, "substring"), F.greatest(_int(start, "substring"), F.lit(0)) + 1
    size = F.greatest(_int(n, "substring"), F.lit(0)) if n else F.char_length(text)
    return Typed(F.when(_int(start, "substring").isNotNull() & (_int(n, "substring").isNotNull() if n else F.lit(True)), F.substr(text, at.cast("int"), size.cast("int"))), STRING)


@function("replace", 3)
def replace(s: Typed, a: Typed, b: Typed) -> Typed:
    return Typed(F.replace(_text(s, "replace"), _text(a, "replace"), _text(b, "replace")), STRING)


@function("left", 2)
def left(s: Typed, n: Typed) -> Typed:
    return Typed(F.left(_text(s, "left"), _int(n, "left").cast("int")), STRING)


@function("right", 2)
def right(s: Typed, n: Typed) -> Typed:
    return Typed(F.right(_text(s, "right"), _int(n, "right").cast("int")), STRING)


def _pad(name: str, build) -> None:
    def pad(s: Typed, width: Typed, fill: Typed | None = None) -> Typed:
        """Only the first character of the fill counts."""
        one = F.left(_text(fill, name), F.lit(1)) if fill else F.lit(" ")
        one = F.when(one == "", " ").otherwise(one)
        w = _int(width, name)
        return Typed(F.when(w.isNotNull(), build(_text(s, name), F.greatest(w, F.lit(0)).cast("int"), one)), STRING)

    function(name, 2, 3)(pad)


_pad("lpad", lambda s, w, p: F.call_function("lpad", s, w, p))
_pad("rpad", lambda s, w, p: F.call_function("rpad", s, w, p))


@function("repeat", 2)
def repeat(s: Typed, n: Typed) -> Typed:
    return Typed(F.repeat(_text(s, "repeat"), F.greatest(_int(n, "repeat"), F.when(_int(n, "repeat").isNotNull(), F.lit(0))).cast("int")), STRING)


# lists


@function("nodes", 1)
def nodes(p: Typed) -> Typed:
    return Typed(_list(p, "nodes").col, _list(p, "nodes").type, p.path)


@function("list_len", 1)
def list_len(x: Typed) -> Typed:
    c = _list(x, "list_len").col
    return Typed(F.when(c.isNotNull(), F.size(c).cast("bigint")), LONG)


@function("list_extract", 2)
def list_extract(x: Typed, i: Typed) -> Typed:
    """1-based, from the end if negative; NULL at 0 and out of range."""
    lst, at = _list(x, "list_extract"), _int(i, "list_extract").cast("int")
    n = F.size(lst.col)
    return Typed(F.when(at > 0, F.get(lst.col, at - 1)).when((at < 0) & (n + at >= 0), F.get(lst.col, n + at)), lst.type.elementType)


@function("list_append", 2)
def list_append(x: Typed, v: Typed) -> Typed:
    c, item, t = _with_item(x, v, "list_append")
    return Typed(F.array_append(c, item), t)


@function("list_prepend", 2)
def list_prepend(v: Typed, x: Typed) -> Typed:
    c, item, t = _with_item(x, v, "list_prepend")
    return Typed(F.array_prepend(c, item), t)


@function("list_concat", 2)
def list_concat(a: Typed, b: Typed) -> Typed:
    a, b = _list(a, "list_concat"), _list(b, "list_concat")
    t = common_type([a.type, b.type])
    if t is None:
        raise BindError("list_concat() takes lists of one type")
    return Typed(F.concat(a.col.cast(t), b.col.cast(t)), t)


@function("list_contains", 2)
def list_contains(x: Typed, v: Typed) -> Typed:
    """Two-valued: NULL is found among NULLs."""
    lst = _list(x, "list_contains")
    if common_type([lst.type.elementType, v.type]) is None:
        return Typed(F.when(lst.col.isNotNull(), F.lit(False)), BOOL)
    c, item, _ = _with_item(x, v, "list_contains")
    return Typed(F.exists(c, lambda e: e.eqNullSafe(item)), BOOL)


@function("list_reverse", 1)
def list_reverse(x: Typed) -> Typed:
    return Typed(F.reverse(_list(x, "list_reverse").col), _list(x, "list_reverse").type)


@function("list_sort", 1)
def list_sort(x: Typed) -> Typed:
    return Typed(F.sort_array(_list(x, "list_sort").col), _list(x, "list_sort").type)


@function("list_distinct", 1)
def list_distinct(x: Typed) -> Typed:
    return Typed(F.array_distinct(_list(x, "list_distinct").col), _list(x, "list_distinct").type)


@function("range", 2, 3)
def range_(a: Typed, b: Typed, step: Typed | None = None) -> Typed:
    """Both ends included; empty if the step leads away from the end."""
    lo, hi = _int(a, "range"), _int(b, "range")
    by = _int(step, "range") if step else F.when(hi >= lo, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    by = F.when(by == 0, F.raise_error(F.lit("range() step must not be 0"))).otherwise(by)
    away = ((by > 0) & (hi < lo)) | ((by < 0) & (hi > lo))
    none = F.array().cast(T.ArrayType(LONG))
    safe_hi = F.when(away, lo).otherwise(hi)
    return Typed(F.when(away, none).otherwise(F.sequence(lo, safe_hi, by)), T.ArrayType(LONG))


# numbers


def _floating(names: dict[str, Callable[[Column], Column]]) -> None:
    for name, build in names.items():
        function(name, 1)(lambda x, n=name, f=build: Typed(f(_number(x, n).col.cast("double")), DOUBLE))


def _log(build) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(build(x))


_floating(
    {
        "ceil": lambda x: F.ceil(x).cast("double"),
        "floor": lambda x: F.floor(x).cast("double"),
        "round": lambda x: F.round(x),
        "sqrt": F.sqrt,
        "log": _log(lambda x: F.ln(x)),
        "log10": _log(F.log10),
    }
)


@function("abs", 1)
def abs_(x: Typed) -> Typed:
    x = _number(x, "abs")
    return Typed(F.abs(x.col), x.type)


@function("sign", 1)
def sign(x: Typed) -> Typed:
    c = _number(x, "sign").col.cast("double")
    return Typed(F.when(F.isnan(c), F.lit(0.0)).otherwise(F.signum(c)).cast("bigint"), LONG)


function("rand", 0)(lambda: Typed(F.rand(), DOUBLE))
function("pi", 0)(lambda: Typed(F.pi(), DOUBLE))
function("e", 0)(lambda: Typed(F.e(), DOUBLE))


@function("tointeger", 1)
def to_integer(x: Typed) -> Typed:
    return Typed(x.col.cast("bigint"), LONG)


@function("tofloat", 1)
def to_float(x: Typed) -> Typed:
    return Typed(x.col.cast("double"), DOUBLE)


# dates


@function("date", 0, 1)
def date(s: Typed | None = None) -> Typed:
    return Typed(F.to_date(_text(s, "date"), "yyyy-MM-dd") if s else F.current_date(), T.DateType())


@function("datetime", 0, 1)
def datetime(s: Typed | None = None) -> Typed:
    return Typed(F.to_timestamp_ntz(_text(s, "datetime"), F.lit("yyyy-MM-dd'T'HH:mm:ss")) if s else F.localtimestamp(), T.TimestampNTZType())


@function("timestamp", 0, 1)
def timestamp(x: Typed | None = None) -> Typed:
    """Seconds since 1970, of a zoneless time or now."""
    if x is None:
        return Typed(F.unix_timestamp().cast("bigint"), LONG)
    if not (is_null(x.type) or isinstance(x.type, (T.TimestampNTZType, T.DateType))):
        raise BindError("timestamp() takes a datetime")
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return Typed(F.timestamp_diff("SECOND", zero, x.col.cast("timestamp_ntz")).cast("bigint"), LONG)


def cast(x: Typed, to: str) -> Typed:
    """CAST(x AS to)."""
    if to in ("INT64", "SERIAL"):
        return Typed(x.col.cast("bigint"), LONG)
    if to == "DOUBLE":
        return Typed((x.col.cast("int") if isinstance(x.type, T.BooleanType) else x.col).cast("double"), DOUBLE)
    if to == "STRING":
        return Typed(text_of(x), STRING)
    if to == "BOOL":
        if isinstance(x.type, T.DoubleType):
            raise BindError("a DOUBLE can't be cast to BOOL")
        if isinstance(x.type, T.StringType):
            word = F.lower(F.trim(x.col))
            return Typed(F.when(word.isin("true", "1", "yes"), True).when(word.isin("false", "0", "no"), False).when(x.col.isNotNull(), F.raise_error(F.concat(F.lit("not a BOOL: "), x.col)).cast("boolean")), BOOL)
        return Typed(x.col.cast("boolean"), BOOL)
    raise BindError(f"can't cast to {to}")

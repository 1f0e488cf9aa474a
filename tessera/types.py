"""Schema types, their Spark types, and the text forms of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that DDL can name; SERIAL is an INT64 that fills itself.
DECLARED = {"INT64": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOL": T.BooleanType(), "SERIAL": T.LongType()}


def normal_type(t: T.DataType) -> T.DataType:
    """Integers are INT64, other numbers DOUBLE, timestamps zoneless."""
    if isinstance(t, T.IntegralType):
        return T.LongType()
    if isinstance(t, (T.FloatType, T.DecimalType)):
        return T.DoubleType()
    if isinstance(t, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(normal_type(t.elementType))
    return t


def normalized(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast(normal_type(f.dataType)).alias(f.name) for f in df.schema.fields])


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def common_type(types: list[T.DataType]) -> T.DataType | None:
    """The type that values of all these types share; None if there is none."""
    found: T.DataType = T.NullType()
    for t in types:
        if is_null(t) or t == found:
            continue
        if is_null(found):
            found = t
        elif is_number(t) and is_number(found):
            found = T.DoubleType()
        elif isinstance(t, T.ArrayType) and isinstance(found, T.ArrayType):
            inner = common_type([t.elementType, found.elementType])
            if inner is None:
                return None
            found = T.ArrayType(inner)
        else:
            return None
    return found


def display(c: Column, t: T.DataType, item_gap: str = ", ") -> Column:
    """Text of a value as results show it; NULL stays NULL."""
    if isinstance(t, T.DoubleType):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%.15f", c), "0+$", ""), r"\.$", "")
        return (
            F.when(F.isnan(c), "NaN")
            .when(c == float("inf"), "inf")
            .when(c == float("-inf"), "-inf")
            .when(whole, c.cast("bigint").cast("string"))
            .when(~c.cast("string").contains("E"), c.cast("string"))
            .otherwise(plain)
        )
    if isinstance(t, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(t, T.BinaryType):
        return F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    if isinstance(t, T.ArrayType):
        items = F.transform(c, lambda x: F.coalesce(display(x, t.elementType, item_gap), F.lit("NULL")))
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(items, item_gap), F.lit("]")))
    return c.cast("string")

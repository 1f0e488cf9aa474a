"""CSV in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import display

NULLS = ("", "NULL", r"\N")
TRUE, FALSE = ("true", "1", "t", "yes"), ("false", "0", "f", "no")


def parsed(c: Column, t: T.DataType) -> Column:
    """A field's value: '', NULL and \\N are NULL; what doesn't parse is an error."""
    c = F.when(~c.isin(*NULLS), c)
    if isinstance(t, T.BooleanType):
        word = F.lower(F.trim(c))
        bad = F.raise_error(F.concat(F.lit("not a BOOL: "), c)).cast("boolean")
        return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False).when(c.isNotNull(), bad)
    return c if isinstance(t, T.StringType) else F.trim(c).cast(t)


def read_csv(spark: SparkSession, path: str, columns: dict[str, T.DataType], header: bool, delimiter: str) -> DataFrame:
    """Columns by position; short rows are filled with NULL, blank lines skipped. Quotes may be doubled; a record is a line."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(path, schema=schema, header=header, sep=delimiter, quote='"', escape='"', ignoreLeadingWhiteSpace=False, nullValue="\u0000", emptyValue="", mode="PERMISSIVE")
    return raw.select(*[parsed(F.col(f"`{c}`"), t).alias(c) for c, t in columns.items()])


def csv_text(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BinaryType):
        return F.concat(F.lit("0x"), F.lower(F.hex(c)))
    return F.coalesce(display(c, t, item_gap=","), F.lit(""))


def write_csv(df: DataFrame, path: str, header: bool, delimiter: str) -> None:
    """One file at path, made by one task; values that need it are quoted. The file takes its name when it is whole."""
    spark = df.sparkSession
    text = df.select(*[csv_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    text.coalesce(1).write.csv(part.toString(), header=header, sep=delimiter, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    (made,) = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(part, "part-*"))] or [None]
    if made is None:
        raise OSError(f"can't write {path}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(made), fs.makeQualified(target), overwrite)
    fs.delete(part, True)

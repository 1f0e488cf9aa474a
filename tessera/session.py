"""The engine's entrance: a session over a Spark session, in memory or over a folder."""

from __future__ import annotations

import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Catalog, NodeTable, RelTable
from tessera.cypher import ast as A
from tessera.cypher.parser import parse, parse_script
from tessera.errors import BindError, TransactionError
from tessera.operators import algorithms, writes
from tessera.plans.checkpoint import with_ordinals
from tessera.plans.expr import constant
from tessera.plans.lower import Lowering
from tessera.plans.scope import walk
from tessera.sources import csv_io
from tessera.sources.store import KEPT_SECONDS, Store
from tessera.types import normalized

_WRITES = (A.Create, A.SetProps, A.Delete, A.Merge)


class GraphSession:
    """root: a folder for versioned tables, or None for tables that live as long as the session."""

    def __init__(self, spark: SparkSession, root: str | None = None, read_only: bool = False):
        self.spark, self.read_only = spark, read_only
        self.store = Store(spark, root) if root else None
        self.catalog = self.store.load() if self.store else Catalog()
        self.functions: dict[str, Callable] = {}
        self.procedures = dict(algorithms.PROCEDURES)
        self._writing = threading.Lock()

    # tables from DataFrames

    def register_nodes(self, name: str, df: DataFrame, key: str) -> None:
        """A node table over df. An integer key serves as the offset too; other keys get ordinals in key order."""
        self.catalog.free(name)
        df = normalized(df)
        columns = {f.name: f.dataType for f in df.schema.fields}
        if key not in columns:
            raise BindError(f"primary key '{key}' is not a column")
        if isinstance(columns[key], T.LongType):
            rows, free = df.select(F.col(f"`{key}`").alias("_id"), "*"), None
        else:
            rows, free = with_ordinals(df.orderBy(f"`{key}`"), "_id")
            rows = rows.select("_id", *[f"`{c}`" for c in columns])
        self.catalog = self.catalog.put(NodeTable(self.catalog.next_table, name, key, columns, rows, free))

    def register_rels(self, name: str, df: DataFrame, source: str, target: str, source_column: str, target_column: str) -> None:
        """A relationship table over df; the two columns hold keys of the endpoint tables, and both ends must exist."""
        self.catalog.free(name)
        df = normalized(df)
        keys = {"#s": source_column, "#t": target_column}
        columns = {f.name: f.dataType for f in df.schema.fields if f.name not in keys.values()}
        rows = df.select(*[F.col(f"`{c}`").alias(k) for k, c in keys.items()], *[f"`{c}`" for c in columns])
        for k, table in (("#s", self.catalog.node(source)), ("#t", self.catalog.node(target))):
            if isinstance(table.columns[table.key], T.LongType) and table.next_id is None:
                continue  # the key is the offset
            ids = table.rows.select(F.col(f"`{table.key}`").alias(k), F.col("_id").alias(k + "id"))
            rows = rows.join(ids, k).drop(k).withColumnRenamed(k + "id", k)
        rows = rows.select(F.monotonically_increasing_id().alias("_rid"), F.col("#s").alias("_src"), F.col("#t").alias("_dst"), *[f"`{c}`" for c in columns])
        self.catalog = self.catalog.put(RelTable(self.catalog.next_table, name, source, target, columns, rows, None))

    def register_function(self, name: str, build: Callable) -> None:
        """build: Columns to a Column."""
        self.functions[name.lower()] = build

    def register_procedure(self, name: str, run: Callable) -> None:
        """run: the session and arguments to a DataFrame."""
        self.procedures[name] = run

    # statements

    def cypher(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """Run one statement; what it returns is lazy, its writes are done."""
        return self._run(parse(text), params or {})

    execute = query = cypher

    def execute_script(self, text: str) -> DataFrame | None:
        """Run statements parted by semicolons, parsed beforehand, until one fails; gives the last one's result."""
        out = None
        for s in parse_script(text):
            out = self._run(s, {})
        return out

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, parse(text))

    def call(self, name: str, *args: Any) -> DataFrame:
        if name not in self.procedures:
            raise BindError(f"unknown procedure '{name}'")
        return self.procedures[name](self, *args)

    def node_table_names(self) -> list[str]:
        return [t.name for t in self.catalog.nodes()]

    def rel_table_names(self) -> list[str]:
        return [t.name for t in self.catalog.rels()]

    def table_schema(self, name: str) -> dict[str, T.DataType]:
        return dict(self.catalog.get(name).columns)

    def checkpoint(self, kept_seconds: float = KEPT_SECONDS) -> None:
        """Drop files of versions that were replaced so long ago."""
        if self.store:
            self.store.checkpoint(kept_seconds)

    def refresh(self) -> None:
        """Take over the folder's newest version."""
        if self.store and not self.store.current():
            self.catalog = self.store.load()

    def commit(self, change: Callable[[Catalog], Catalog], wait: bool = False) -> None:
        """Apply change to the newest version as its only writer; wait for another one of this session, or fail."""
        if self.read_only:
            raise TransactionError("the session is read-only")
        if not self._writing.acquire(blocking=wait):
            raise TransactionError("another write transaction is active")
        try:
            self.refresh()
            before = self.catalog
            after = change(before)
            self.catalog = self.store.publish(before, after) if self.store and after is not before else after
        finally:
            self._writing.release()

    def _run(self, s: Any, params: dict[str, Any]) -> DataFrame:
        if isinstance(s, A.CallProcedure):
            return self._call(s, params)
        if isinstance(s, A.CopyTo):
            self._copy_to(s, params)
            return self._empty()
        writing = isinstance(s, (A.CreateNodeTable, A.CreateRelTable, A.DropTable, A.AlterTable, A.CopyFrom)) or any(isinstance(x, _WRITES) for x in walk(s))
        return self._write(s, params) if writing else self._read(s, params, self.catalog)

    def _read(self, s: Any, params: dict[str, Any], catalog: Catalog) -> DataFrame:
        if isinstance(s, A.Union):
            left, right = self._read(s.left, params, catalog), self._read(s.right, params, catalog)
            if len(left.columns) != len(right.columns):
                raise BindError("UNION takes queries of equally many columns")
            both = left.union(right.toDF(*left.columns))
            return both if s.every else both.distinct()
        return self._visible(Lowering(self.spark, catalog, params, self.functions).query(s.clauses).df, s.clauses)

    @staticmethod
    def _visible(df: DataFrame, clauses: tuple) -> DataFrame:
        if not any(isinstance(c, A.Projection) and not c.continues for c in clauses):
            return df.select(*[f"`{c}`" for c in df.columns if "#" not in c])
        return df

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def _write(self, s: Any, params: dict[str, Any]) -> DataFrame:
        """One writer at a time; readers keep the version they began with. A failed write leaves the old version."""
        out = [self._empty()]

        def change(before: Catalog) -> Catalog:
            if isinstance(s, A.CopyFrom):
                return writes.copy_from(before, self.spark, s)
            if isinstance(s, A.Query):
                writer = writes.Writer(before)
                frame = Lowering(self.spark, before, params, self.functions).query(s.clauses, writer)
                out[0] = self._visible(frame.df, s.clauses)
                return writer.catalog
            if isinstance(s, A.Union):
                raise BindError("UNION can't write")
            return writes.define(before, self.spark, s)

        self.commit(change)
        return out[0]

    def _call(self, s: A.CallProcedure, params: dict[str, Any]) -> DataFrame:
        out = self.call(s.name, *[constant(a, params) for a in s.args])
        for y in s.yields:
            if y not in out.columns:
                raise BindError(f"'{s.name}' yields no '{y}'")
        return out.select(*s.yields) if s.yields else out

    def _copy_to(self, s: A.CopyTo, params: dict[str, Any]) -> None:
        if isinstance(s.source, str):
            table = self.catalog.node(s.source)
            df = table.rows.orderBy("_id").select(*[f"`{c}`" for c in table.columns])
        else:
            df = self._read(s.source, params, self.catalog)
        csv_io.write_csv(df, s.path, s.header, s.delimiter)


class Prepared:
    """A parsed statement, to be run with parameters."""

    def __init__(self, session: GraphSession, statement: Any):
        self.session, self.statement = session, statement

    def execute(self, params: dict[str, Any] | None = None) -> DataFrame:
        return self.session._run(self.statement, params or {})

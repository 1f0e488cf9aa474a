"""Writes: each makes a new version of the tables that it touches."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Catalog, NodeTable, Part, RelTable, declared, of_parts, parts_of
from tessera.cypher import ast as A
from tessera.errors import BindError, ConstraintError
from tessera.functions.scalar import Typed
from tessera.plans.checkpoint import cut, with_ordinals
from tessera.plans.scope import Binding, Frame, col
from tessera.sources import csv_io
from tessera.types import is_null, is_number


ROWS_OF_A_FILE = 1_000_000


def fitted(x: Typed, t: T.DataType, what: str) -> Column:
    """The value as the column's type; integers become doubles, anything else must fit."""
    if x.type == t or is_null(x.type) or (isinstance(t, T.DoubleType) and is_number(x.type)):
        return x.col.cast(t)
    raise BindError(f"{what} takes {t.simpleString()}, not {x.type.simpleString()}")


def check_keys(key: str, new: DataFrame, old: DataFrame | None) -> None:
    k = col(key)
    if not new.where(k.isNull()).isEmpty():
        raise ConstraintError(f"primary key '{key}' is NULL")
    if not new.groupBy(k).count().where("count > 1").isEmpty() or (old is not None and not new.select(k).join(old.select(k), key, "left_semi").isEmpty()):
        raise ConstraintError(f"duplicate primary key '{key}'")


def first_free(table: NodeTable | RelTable) -> int:
    """The next offset; of a table that was registered with its rows, one more than the largest."""
    if table.next_id is not None:
        return table.next_id
    top = table.rows.agg(F.max("_id" if isinstance(table, NodeTable) else "_rid")).first()[0]
    return 0 if top is None else top + 1


def appended(table: NodeTable | RelTable, new: DataFrame, count: int) -> NodeTable | RelTable:
    """The table with one more part. A part is merged with the one before it while that is no larger, so a row is copied as
    often as the number of appends has digits, and a table of many appends has few parts."""
    files = lambda n: max(1, -(-n // ROWS_OF_A_FILE))
    each = [*parts_of(table), Part(cut(new.coalesce(files(count))), count)]
    while len(each) > 1 and each[-2].count is not None and each[-2].count <= each[-1].count:
        last, before = each.pop(), each.pop()
        both = before.count + last.count
        each.append(Part(cut(before.rows.unionByName(last.rows).coalesce(files(both))), both))
    rows, parts = of_parts(tuple(p for p in each if p.count != 0) or tuple(each[:1]))
    return replace(table, rows=rows, parts=parts)


def add_nodes(table: NodeTable, new: DataFrame) -> tuple[NodeTable, DataFrame]:
    """The table with new rows (its columns), and those rows with their _id. SERIAL columns that are wholly absent fill
    themselves from their counters."""
    numbered, after = with_ordinals(new, "_id", first_free(table))
    first = first_free(table)
    serial = dict(table.serial)
    for c, at in table.serial.items():
        if c not in new.columns:
            numbered = numbered.withColumn(c, F.lit(at - first) + F.col("_id"))
            serial[c] = at + after - first
    for c, t in table.columns.items():
        if c not in numbered.columns:
            numbered = numbered.withColumn(c, F.lit(None).cast(t))
    numbered = cut(numbered.select("_id", *[col(c) for c in table.columns]))
    check_keys(table.key, numbered, table.rows)
    return replace(appended(table, numbered, after - first), next_id=after, serial=serial), numbered


def add_rels(table: RelTable, new: DataFrame) -> RelTable:
    first = first_free(table)
    numbered, after = with_ordinals(new, "_rid", first)
    for c, t in table.columns.items():
        if c not in numbered.columns:
            numbered = numbered.withColumn(c, F.lit(None).cast(t))
    numbered = numbered.select("_rid", "_src", "_dst", *[col(c) for c in table.columns])
    return replace(appended(table, numbered, after - first), next_id=after)


class Writer:
    """Applies the writing clauses of one statement to a working catalog."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def apply(self, lowering, frame: Frame | None, c: Any) -> Frame:
        frame = lowering.unit(frame)
        if frame.scope:
            frame = frame.with_df(cut(frame.df))
        if isinstance(c, A.Create):
            for p in c.paths:
                frame = self._create(lowering, frame, p)
            return frame
        if isinstance(c, A.SetProps):
            return self._set(lowering, frame, c.items)
        if isinstance(c, A.Delete):
            return self._delete(frame, c)
        if isinstance(c, A.Merge):
            return self._merge(lowering, frame, c)
        raise BindError(f"unexpected clause {type(c).__name__}")

    def _create(self, lowering, frame: Frame, p: A.PathPat) -> Frame:
        if p.mode:
            raise BindError("a shortest path can't be created")
        for n in p.nodes:
            if n.var not in frame.scope:
                frame = self._create_node(lowering, frame, n)
            elif frame.scope[n.var].kind != "node":
                raise BindError(f"'{n.var}' is not a node")
        for k, r in enumerate(p.rels):
            a, b = p.nodes[k].var, p.nodes[k + 1].var
            if not r.kind or r.varied:
                raise BindError("a created relationship has one type and one hop")
            table = self.catalog.rel(r.kind)
            if r.direction == "<":
                a, b = b, a
            for var, end in ((a, table.source), (b, table.target)):
                if frame.scope[var].tables != (end,):
                    raise BindError(f"'{var}' is not a {end}, as '{table.name}' asks")
            comp = lowering.compiler(frame)
            values = [fitted(comp.typed(v), self._type(table, name), f"{table.name}.{name}").alias(name) for name, v in r.props]
            new = frame.df.select(col(a).alias("_src"), col(b).alias("_dst"), *values).where("_src is not null and _dst is not null")
            self.catalog = self.catalog.put(add_rels(table, new))
        return frame

    @staticmethod
    def _type(table: NodeTable | RelTable, name: str) -> T.DataType:
        if name not in table.columns:
            raise BindError(f"unknown property '{name}' of '{table.name}'")
        return table.columns[name]

    def _create_node(self, lowering, frame: Frame, n: A.NodePat) -> Frame:
        if n.label is None:
            raise BindError("a created node has a label")
        table = self.catalog.node(n.label)
        comp = lowering.compiler(frame)
        values = [fitted(comp.typed(v), self._type(table, name), f"{table.name}.{name}").alias(name) for name, v in n.props]
        if not frame.scope:
            table, made = add_nodes(table, frame.df.select(*values) if values else frame.df.select(F.lit(None).alias("#none")).drop("#none"))
            self.catalog = self.catalog.put(table)
            return Frame(self._bound(made, n.var, table), {n.var: Binding("node", (table.name,))})
        # a row of the frame and its node share an ordinal
        rows, _ = with_ordinals(frame.df.select("*", *[v.alias(f"#new.{name}") for v, (name, _) in zip(values, n.props)]), "#row")
        rows = cut(rows)
        table, made = add_nodes(table, rows.orderBy("#row").select(*[col(f"#new.{name}").alias(name) for name, _ in n.props]) if n.props else rows.select("#row").drop("#row"))
        low = made.agg(F.min("_id")).first()[0] or 0
        self.catalog = self.catalog.put(table)
        joined = rows.drop(*[f"#new.{name}" for name, _ in n.props]).join(self._bound(made, n.var, table), F.col("#row") + F.lit(low) == col(n.var)).drop("#row")
        return Frame(joined, {**frame.scope, n.var: Binding("node", (table.name,))})

    @staticmethod
    def _bound(rows: DataFrame, var: str, table: NodeTable) -> DataFrame:
        return rows.select(F.col("_id").alias(var), *[col(c).alias(f"{var}.{c}") for c in table.columns])

    def _set(self, lowering, frame: Frame, items: tuple) -> Frame:
        comp, by_var = lowering.compiler(frame), {}
        for var, prop, e in items:
            if var not in frame.scope or frame.scope[var].kind == "scalar" or len(frame.scope[var].tables) != 1:
                raise BindError(f"'{var}' is not a node or relationship of one table")
            table = self.catalog.get(frame.scope[var].tables[0])
            by_var.setdefault(var, {})[prop] = fitted(comp.typed(e), self._type(table, prop), f"{table.name}.{prop}")
        made = cut(frame.df.select("*", *[c.alias(f"#set.{v}.{p}") for v, props in by_var.items() for p, c in props.items()]))
        df = made
        for var, props in by_var.items():
            table = self.catalog.get(frame.scope[var].tables[0])
            own = "_id" if isinstance(table, NodeTable) else "_rid"
            new = made.where(col(var).isNotNull()).select(col(var).alias(own), F.lit(True).alias("#hit"), *[col(f"#set.{var}.{p}") for p in props]).dropDuplicates([own])
            joined = table.rows.join(new, own, "left")
            rows = cut(joined.select(*[F.when(F.col("#hit"), col(f"#set.{var}.{c}")).otherwise(col(c)).alias(c) if c in props else col(c) for c in table.rows.columns]))
            if isinstance(table, NodeTable) and table.key in props:
                check_keys(table.key, rows, None)
            self.catalog = self.catalog.put(replace(table, rows=rows))
            for p in props:
                df = df.withColumn(f"{var}.{p}", F.when(col(var).isNotNull(), col(f"#set.{var}.{p}")))
        return frame.with_df(df.select(*[col(c) for c in frame.df.columns]))

    def _delete(self, frame: Frame, c: A.Delete) -> Frame:
        for e in c.targets:
            if not isinstance(e, A.Var) or e.name not in frame.scope or frame.scope[e.name].kind == "scalar":
                raise BindError("DELETE takes node and relationship variables")
        targets = sorted(c.targets, key=lambda e: frame.scope[e.name].kind != "rel")  # relationships first
        for e in targets:
            for name in frame.scope[e.name].tables:
                table = self.catalog.get(name)
                gone = frame.df.where(col(f"{e.name}.#label") == name) if len(frame.scope[e.name].tables) > 1 else frame.df
                gone = gone.select(col(e.name).alias("#gone")).where("`#gone` is not null").distinct()
                if isinstance(table, RelTable):
                    self.catalog = self.catalog.put(replace(table, rows=cut(table.rows.join(gone, F.col("_rid") == F.col("#gone"), "left_anti"))))
                    continue
                for rel in self.catalog.rels():
                    for end, side in ((rel.source, "_src"), (rel.target, "_dst")):
                        if end == name:
                            rel = self.catalog.rel(rel.name)
                            if not c.detach and not rel.rows.join(gone, F.col(side) == F.col("#gone"), "left_semi").isEmpty():
                                raise ConstraintError(f"a deleted {name} has relationships in '{rel.name}'; use DETACH DELETE")
                            if c.detach:
                                self.catalog = self.catalog.put(replace(rel, rows=cut(rel.rows.join(gone, F.col(side) == F.col("#gone"), "left_anti"))))
                self.catalog = self.catalog.put(replace(table, rows=cut(table.rows.join(gone, F.col("_id") == F.col("#gone"), "left_anti"))))
        return frame

    def _merge(self, lowering, frame: Frame, c: A.Merge) -> Frame:
        n = c.node
        if frame.scope:
            raise BindError("MERGE stands at the head of a statement")
        if n.label is None:
            raise BindError("a merged node has a label")
        table, comp = self.catalog.node(n.label), lowering.compiler(frame)
        same = F.lit(True)
        for name, v in n.props:
            same = same & col(name).eqNullSafe(fitted(comp.typed(v), self._type(table, name), f"{table.name}.{name}"))
        hit = cut(table.rows.where(same).orderBy("_id").limit(1))
        created = hit.isEmpty()
        made = self._create_node(lowering, frame, n) if created else Frame(self._bound(hit, n.var, table), {n.var: Binding("node", (table.name,))})
        lowering.catalog = self.catalog
        items = c.on_create if created else c.on_match
        return self._set(lowering, made, items) if items else made


def define(catalog: Catalog, spark, s: Any) -> Catalog:
    """DDL."""
    if isinstance(s, A.CreateNodeTable):
        catalog.free(s.name)
        columns = declared(s.columns)
        if s.key not in columns:
            raise BindError(f"primary key '{s.key}' is not a column")
        schema = T.StructType([T.StructField("_id", T.LongType()), *[T.StructField(c, t) for c, t in columns.items()]])
        serial = {c: 0 for c, kind in s.columns if kind == "SERIAL"}
        return catalog.put(NodeTable(catalog.next_table, s.name, s.key, columns, spark.createDataFrame([], schema), 0, serial))
    if isinstance(s, A.CreateRelTable):
        catalog.free(s.name)
        catalog.node(s.source), catalog.node(s.target)
        columns = declared(s.columns)
        schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("_rid", "_src", "_dst")], *[T.StructField(c, t) for c, t in columns.items()]])
        return catalog.put(RelTable(catalog.next_table, s.name, s.source, s.target, columns, spark.createDataFrame([], schema), 0))
    if isinstance(s, A.DropTable):
        return catalog.drop(s.name)
    table = catalog.get(s.name)
    if s.action == "rename":
        return catalog.rename(s.name, s.names[0])
    if s.action == "add":
        name, kind = s.names
        if name in table.columns:
            raise BindError(f"column '{name}' already exists")
        t = declared((s.names,))[name]
        return catalog.put(replace(table, columns={**table.columns, name: t}, rows=table.rows.withColumn(name, F.lit(None).cast(t))))
    old = s.names[0]
    if old not in table.columns:
        raise BindError(f"unknown column '{old}'")
    if s.action == "drop":
        if isinstance(table, NodeTable) and table.key == old:
            raise BindError("the primary key can't be dropped")
        changed = replace(table, columns={c: t for c, t in table.columns.items() if c != old}, rows=table.rows.drop(old))
        return catalog.put(replace(changed, serial={c: n for c, n in table.serial.items() if c != old}) if isinstance(table, NodeTable) else changed)
    new = s.names[1]
    if new in table.columns:
        raise BindError(f"column '{new}' already exists")
    changed = replace(table, columns={new if c == old else c: t for c, t in table.columns.items()}, rows=table.rows.withColumnRenamed(old, new))
    if isinstance(table, NodeTable):
        changed = replace(changed, key=new if table.key == old else table.key, serial={new if c == old else c: n for c, n in table.serial.items()})
    return catalog.put(changed)


def copy_from(catalog: Catalog, spark, s: A.CopyFrom) -> Catalog:
    table = catalog.node(s.table)
    rows = csv_io.read_csv(spark, s.path, table.columns, s.header, s.delimiter)
    made, _ = add_nodes(table, rows)
    return catalog.put(made)

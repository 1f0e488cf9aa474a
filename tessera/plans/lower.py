"""Clauses to DataFrame plans, one after the other."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.catalog import Catalog, RelTable
from tessera.cypher import ast as A
from tessera.errors import BindError
from tessera.functions.aggregate import NAMES as AGGREGATES
from tessera.functions.aggregate import aggregate
from tessera.functions.scalar import Typed
from tessera.plans import traverse
from tessera.plans.expr import Compiler, constant
from tessera.plans.scope import LABEL, Binding, Frame, col, conjuncts, default_name, pattern_variables, rebuild, variables, walk
from tessera.types import is_null


class Lowering:
    """Lowers the clauses of one statement; catalog is the version that it reads."""

    def __init__(self, spark: SparkSession, catalog: Catalog, params: dict[str, Any], functions: dict[str, Any]):
        self.spark, self.catalog, self.params, self.functions = spark, catalog, params, functions
        self.read: set[str] | None = None  # variables whose properties the statement reads; None: all
        self.marks = 0

    # clauses

    def query(self, clauses: tuple, writer=None) -> Frame:
        self.read = self._read_variables(clauses)
        frame: Frame | None = None
        k = 0
        while k < len(clauses):
            c = clauses[k]
            k += 1
            if isinstance(c, A.Match):
                wheres = []
                while k < len(clauses) and isinstance(clauses[k], A.Where):
                    wheres.append(clauses[k].expr)
                    k += 1
                where = [x for w in [c.where, *wheres] for x in conjuncts(w)]
                frame = self.optional(frame, c.paths, where) if c.optional else self.match(frame, c.paths, where)
            elif isinstance(c, A.Where):
                frame = self.where(self.unit(frame), conjuncts(c.expr))
            elif isinstance(c, A.Projection):
                keys: tuple = ()
                if k < len(clauses) and isinstance(clauses[k], A.OrderBy):
                    keys = clauses[k].keys
                    k += 1
                frame = self.project(self.unit(frame), c, keys)
            elif isinstance(c, A.OrderBy):
                frame = self.unit(frame)
                frame = frame.with_df(frame.df.orderBy(*[self._sorted(Compiler(frame, self.params, self.functions).typed(e).col, down) for e, down in c.keys]))
            elif isinstance(c, (A.Skip, A.Limit)):
                n = constant(c.count, self.params)
                if not isinstance(n, int):
                    raise BindError("SKIP and LIMIT take an integer")
                frame = self.unit(frame)
                frame = frame.with_df(frame.df.offset(max(0, n)) if isinstance(c, A.Skip) else frame.df.limit(max(0, n)))
            elif isinstance(c, A.Unwind):
                frame = self.unwind(self.unit(frame), c)
            elif isinstance(c, A.Subquery):
                if any(isinstance(x, (A.Create, A.SetProps, A.Delete, A.Merge)) for x in walk(c.clauses)):
                    raise BindError("a subquery can't write")
                inner = Lowering(self.spark, self.catalog, self.params, self.functions).query(c.clauses)
                if frame is None:
                    frame = inner
                else:
                    both = set(frame.scope) & set(inner.scope)
                    if both:
                        raise BindError(f"the subquery returns names that are taken: {', '.join(sorted(both))}")
                    frame = Frame(frame.df.crossJoin(inner.df), {**frame.scope, **inner.scope})
            elif writer is not None:
                frame = writer.apply(self, frame, c)
                self.catalog = writer.catalog
            else:
                raise BindError("this query can't write")
        return self.unit(frame)

    @staticmethod
    def _read_variables(clauses: tuple) -> set[str] | None:
        found = set()
        for x in walk(clauses):
            if isinstance(x, A.Projection) and not x.items or isinstance(x, (A.Create, A.SetProps, A.Delete, A.Merge)):
                return None
            if isinstance(x, A.Prop) and isinstance(x.base, A.Var):
                found.add(x.base.name)
            if isinstance(x, A.Item) and isinstance(x.expr, A.Var) and x.alias not in (None, x.expr.name):
                found.add(x.expr.name)
            if isinstance(x, (A.NodePat, A.RelPat)) and x.props and x.var:
                found.add(x.var)
        return found

    def unit(self, frame: Frame | None) -> Frame:
        """The frame, or one row without columns."""
        return frame or Frame(self.spark.range(1).select(), {})

    def compiler(self, frame: Frame) -> Compiler:
        return Compiler(frame, self.params, self.functions)

    @staticmethod
    def _sorted(c, down: bool):
        return c.desc_nulls_first() if down else c.asc_nulls_last()

    # patterns

    def _label(self, n: A.NodePat, scope: dict[str, Binding]) -> list[str]:
        if n.label is not None:
            self.catalog.node(n.label)
        if n.var in scope:
            b = scope[n.var]
            if b.kind != "node":
                raise BindError(f"'{n.var}' is not a node")
            return [t for t in b.tables if n.label in (None, t)]
        return [n.label] if n.label else [t.name for t in self.catalog.nodes()]

    def assignments(self, paths: tuple, scope: dict[str, Binding]) -> list[dict]:
        """Every way to give the pattern's nodes a table and its relationships one, endpoints fitting."""
        labels: dict[str, list[str]] = {}
        for p in paths:
            for n in p.nodes:
                fit = self._label(n, scope)
                labels[n.var] = [t for t in labels.get(n.var, fit) if t in fit]
        out: list[dict] = [{}]
        for i, p in enumerate(paths):
            for k, r in enumerate(p.rels):
                a, b = p.nodes[k].var, p.nodes[k + 1].var
                rels = [self.catalog.rel(r.kind)] if r.kind else self.catalog.rels()
                grown = []
                for given in out:
                    for rel in rels:
                        for left, right in self._ends(r, rel):
                            if given.get(a, left) == left and given.get(b, right) == right and left in labels[a] and right in labels[b] and (a != b or left == right):
                                grown.append({**given, a: left, b: right, (i, k): rel.name})
                out = [dict(t) for t in dict.fromkeys(tuple(g.items()) for g in grown)]
        for var, tables in labels.items():
            out = [{**given, var: given.get(var, t)} for given in out for t in ([given[var]] if var in given else tables)]
        return out

    @staticmethod
    def _ends(r: A.RelPat, rel: RelTable) -> list[tuple[str, str]]:
        ways = {">": [(rel.source, rel.target)], "<": [(rel.target, rel.source)], "-": [(rel.source, rel.target), (rel.target, rel.source)]}[r.direction]
        if r.varied and rel.source != rel.target and (r.most is None or r.most > 1):
            if r.kind:
                raise BindError(f"'{rel.name}' joins two tables; it can be followed for one hop only")
            return []
        return ways

    def _inline(self, paths: tuple) -> list:
        out = []
        for p in paths:
            for x in (*p.nodes, *p.rels):
                for name, value in x.props:
                    if isinstance(x, A.RelPat) and x.var is None:
                        continue  # applied to the edges themselves
                    out.append(A.Binary("=", A.Prop(A.Var(x.var), name), value))
        return out

    def match(self, frame: Frame | None, paths: tuple, where: list) -> Frame:
        scope = frame.scope if frame else {}
        known = set(scope) | pattern_variables(paths) | {p.name for p in paths if p.name}
        for e in where:
            for v in variables(e) - known - self._inner(e):
                raise BindError(f"undefined variable '{v}'")
        plain = tuple(p for p in paths if not p.mode)
        late = [p for p in paths if p.mode]
        where = where + self._inline(plain)
        if plain:
            frame, where = self._matched(frame, plain, where)
        for p in late:
            frame, where = self._ready(frame, where)
            frame = self.shortest_path(frame, p)
        return self.where(frame, where)

    @staticmethod
    def _inner(e: Any) -> set[str]:
        return {v for x in walk(e) if isinstance(x, A.Exists) for m in walk(x.clauses) if isinstance(m, A.Match) for v in pattern_variables(m.paths)}

    def _matched(self, frame: Frame | None, paths: tuple, where: list, ids_only: frozenset = frozenset()) -> tuple[Frame, list]:
        ways = self.assignments(paths, frame.scope if frame else {})
        if not ways:
            return self._nothing(frame, paths), []
        made = [self._typed(frame, paths, w, where, ids_only) for w in ways]
        if len(made) == 1:
            return made[0]
        bound = set(frame.scope) if frame else set()
        several = {n.var for p in paths for n in p.nodes if n.var not in bound and len({w[n.var] for w in ways}) > 1}
        df, scope = None, dict(frame.scope) if frame else {}
        for (one, left), w in zip(made, ways):
            if left:
                one = self.where(one, left)
            part = one.df
            for v in several:
                part = part.withColumn(f"{v}.{LABEL}", F.lit(w[v]))
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
            for v, b in one.scope.items():
                had = scope.get(v)
                scope[v] = b if had is None else replace(b, tables=tuple(dict.fromkeys((*had.tables, *b.tables))))
        return Frame(df, scope), []

    def _nothing(self, frame: Frame | None, paths: tuple) -> Frame:
        """No tables fit the pattern: its columns, as far as they are known, without rows."""
        frame = self.unit(frame)
        df, scope = frame.df, dict(frame.scope)
        for p in paths:
            for n in p.nodes:
                if n.var not in scope:
                    table = self.catalog.node(n.label) if n.label else None
                    df = df.withColumn(n.var, F.lit(None).cast("bigint"))
                    for c, t in (table.columns if table else {}).items():
                        df = df.withColumn(f"{n.var}.{c}", F.lit(None).cast(t))
                    scope[n.var] = Binding("node", (n.label,) if n.label else ())
            for r in p.rels:
                if r.var and r.var not in scope:
                    df = df.withColumn(r.var, F.lit(None).cast("bigint"))
                    for c, t in (self.catalog.rel(r.kind).columns if r.kind else {}).items():
                        df = df.withColumn(f"{r.var}.{c}", F.lit(None).cast(t))
                    scope[r.var] = Binding("rel", (r.kind,) if r.kind else ())
        return Frame(df.where(F.lit(False)), scope)

    def _ready(self, frame: Frame | None, where: list) -> tuple[Frame | None, list]:
        """Filter by the conjuncts that read bound variables alone."""
        if frame is None:
            return frame, where
        now = [e for e in where if not any(isinstance(x, A.Exists) for x in walk(e)) and variables(e) <= set(frame.scope)]
        for e in now:
            frame = frame.with_df(frame.df.where(self.compiler(frame).predicate(e)))
        return frame, [e for e in where if e not in now]

    def _typed(self, frame: Frame | None, paths: tuple, given: dict, where: list, ids_only: frozenset) -> tuple[Frame, list]:
        for i, p in enumerate(paths):
            bound = set(frame.scope) if frame else set()
            start = next((k for k, n in enumerate(p.nodes) if n.var in bound), 0)
            first = p.nodes[start].var
            if first in bound:
                frame = self._of_table(frame, first, given[first])
            elif frame is None and first in ids_only and p.rels and (p.rels[0].least, p.rels[0].most) == (1, 1):
                frame = self._first_hop(p, given, self.catalog.rel(given[i, 0]), ids_only)  # no scan of what is joined by id
                start = 1
            else:
                frame = self._scanned(frame, first, given[first], ids_only)
            frame, where = self._ready(frame, where)
            for k in range(start, len(p.rels)):
                frame = self._expanded(frame, p.nodes[k].var, p.rels[k], p.nodes[k + 1].var, given, self.catalog.rel(given[i, k]), ids_only)
                frame, where = self._ready(frame, where)
            if p.nodes[start].var not in bound:
                continue
            flipped = {">": "<", "<": ">", "-": "-"}
            for k in range(start - 1, -1, -1):
                back = replace(p.rels[k], direction=flipped[p.rels[k].direction])
                frame = self._expanded(frame, p.nodes[k + 1].var, back, p.nodes[k].var, given, self.catalog.rel(given[i, k]), ids_only)
                frame, where = self._ready(frame, where)
        return frame, where

    def _of_table(self, frame: Frame, var: str, table: str) -> Frame:
        if len(frame.scope[var].tables) < 2:
            return frame
        narrowed = {**frame.scope, var: replace(frame.scope[var], tables=(table,))}
        return Frame(frame.df.where(col(f"{var}.{LABEL}") == table), narrowed)

    def _node_columns(self, var: str, table: str, ids_only: frozenset = frozenset()) -> DataFrame:
        t = self.catalog.node(table)
        wanted = {} if var in ids_only else t.columns
        return t.rows.select(F.col("_id").alias(var), *[col(c).alias(f"{var}.{c}") for c in wanted])

    def _scanned(self, frame: Frame | None, var: str, table: str, ids_only: frozenset) -> Frame:
        rows = self._node_columns(var, table, ids_only)
        df = rows if frame is None else frame.df.crossJoin(rows)
        return Frame(df, {**(frame.scope if frame else {}), var: Binding("node", (table,))})

    def _edges(self, rel: RelTable, r: A.RelPat, left: str, right: str) -> DataFrame:
        """`#from`, `#to` in the pattern's direction, with the relationship's own columns if it has a variable. Undirected
        relationships count from both ends, so a loop counts twice."""
        rows = rel.rows
        if r.var is None:
            for name, value in r.props:
                if name not in rel.columns:
                    raise BindError(f"unknown property '{name}' of '{rel.name}'")
                probe = Frame(rows.select(*[col(c).alias(f"#r.{c}") if c in rel.columns else col(c) for c in rows.columns]), {"#r": Binding("rel", (rel.name,))})
                kept = probe.df.where(self.compiler(probe).predicate(A.Binary("=", A.Prop(A.Var("#r"), name), value)))
                rows = kept.select(*[col(f"#r.{c}").alias(c) if c in rel.columns else col(c) for c in rows.columns])
        own = [F.col("_rid").alias(r.var), *[col(c).alias(f"{r.var}.{c}") for c in rel.columns]] if r.var else []
        ahead = rows.select(F.col("_src").alias("#from"), F.col("_dst").alias("#to"), *own)
        back = rows.select(F.col("_dst").alias("#from"), F.col("_src").alias("#to"), *own)
        if r.direction == ">":
            return ahead
        if r.direction == "<":
            return back
        ways = [e for e, ends in ((ahead, (rel.source, rel.target)), (back, (rel.target, rel.source))) if ends == (left, right)]
        return ways[0] if len(ways) == 1 else ways[0].unionAll(ways[1])

    def _expanded(self, frame: Frame, left: str, r: A.RelPat, right: str, given: dict, rel: RelTable, ids_only: frozenset) -> Frame:
        edges, scope = self._edges(rel, r, given[left], given[right]), dict(frame.scope)
        if r.varied and (r.least, r.most) != (1, 1):
            if r.var:
                raise BindError("a relationship of several hops has no variable")
            frame = self._of_table(frame, left, given[left])
            seeds = frame.df.select(col(left).alias("#seed")).where("`#seed` is not null").distinct()
            edges = traverse.reach(edges, seeds, r.least, r.most).select(F.col("#seed").alias("#from"), F.col("#node").alias("#to"))
        scope = self._with_rel(scope, r, rel)
        return self._arrived(Frame(frame.df.join(edges, col(left) == F.col("#from")), scope), right, given, ids_only)

    def _first_hop(self, p: A.PathPat, given: dict, rel: RelTable, ids_only: frozenset) -> Frame:
        """A pattern that starts with its first relationship, whose source is known by its id alone."""
        left, r, right = p.nodes[0].var, p.rels[0], p.nodes[1].var
        edges = self._edges(rel, r, given[left], given[right]).withColumn(left, F.col("#from"))
        scope = self._with_rel({left: Binding("node", (given[left],))}, r, rel)
        return self._arrived(Frame(edges, scope), right, given, ids_only)

    @staticmethod
    def _with_rel(scope: dict[str, Binding], r: A.RelPat, rel: RelTable) -> dict[str, Binding]:
        if r.var is None:
            return scope
        if r.var in scope:
            raise BindError(f"'{r.var}' is already bound")
        return {**scope, r.var: Binding("rel", (rel.name,))}

    def _arrived(self, frame: Frame, right: str, given: dict, ids_only: frozenset) -> Frame:
        """Bind the node at `#to`, or hold it against what it is bound to."""
        df, scope = frame.df, frame.scope
        if right in scope:
            frame = self._of_table(frame, right, given[right])
            return Frame(frame.df.where(F.col("#to") == col(right)).drop("#from", "#to"), frame.scope)
        scope = {**scope, right: Binding("node", (given[right],))}
        if right in ids_only or (self.read is not None and right not in self.read):
            return Frame(df.withColumn(right, F.col("#to")).drop("#from", "#to"), scope)  # relationships have both their ends
        rows = self._node_columns(right, given[right])
        return Frame(df.join(rows, F.col("#to") == col(right)).drop("#from", "#to"), scope)

    def shortest_path(self, frame: Frame | None, p: A.PathPat) -> Frame:
        if len(p.rels) != 1:
            raise BindError("a shortest path has one relationship")
        a, b, r = p.nodes[0].var, p.nodes[1].var, p.rels[0]
        for n in p.nodes:
            if frame is None or n.var not in frame.scope:
                if n.label is None:
                    raise BindError(f"undefined variable '{n.var}'")
                frame = self.match(frame, (A.PathPat((n,), ()),), [])
        if not r.kind:
            raise BindError("a shortest path needs a relationship type")
        rel = self.catalog.rel(r.kind)
        if rel.source != rel.target and (r.most is None or r.most > 1):
            raise BindError(f"'{rel.name}' joins two tables; it can be followed for one hop only")
        edges = self._edges(rel, r, rel.source, rel.target)
        pairs = frame.df.select(col(a).alias("#a"), col(b).alias("#b")).where("`#a` is not null and `#b` is not null")
        found = traverse.shortest(edges, pairs, r.most, p.mode == "all")
        df = frame.df.join(found, (col(a) == F.col("#a")) & (col(b) == F.col("#b"))).withColumnRenamed("#path", p.name).drop("#a", "#b")
        return Frame(df, {**frame.scope, p.name: Binding("scalar", path=True)})

    def _part(self, frame: Frame, paths: tuple, where: list) -> tuple[DataFrame, Any, Frame]:
        """A pattern for itself, its shared variables renamed to `#v`, the condition that joins it to the frame, and the
        frame that both make."""
        if any(p.mode for p in paths):
            raise BindError("shortest paths aren't allowed in OPTIONAL MATCH and EXISTS")
        shared = pattern_variables(paths) & set(frame.scope)
        for v in shared:
            if frame.scope[v].kind != "node":
                raise BindError(f"'{v}' is not a node")
        narrowed = tuple(
            replace(p, nodes=tuple(replace(n, label=n.label or (frame.scope[n.var].tables[0] if n.var in shared and len(frame.scope[n.var].tables) == 1 else None)) for n in p.nodes))
            for p in paths
        )
        where = where + self._inline(paths)
        inner = [e for e in where if not any(isinstance(x, A.Exists) for x in walk(e)) and variables(e) <= pattern_variables(paths) and not variables(e) & shared]
        part, left = self._matched(None, narrowed, inner, frozenset(shared))
        if left:
            part = self.where(part, left)
        df = part.df
        for v in shared:
            df = df.withColumnRenamed(v, f"#{v}")
        new = {v: b for v, b in part.scope.items() if v not in shared}
        both = Frame(frame.df.join(df, F.lit(True), "cross"), {**frame.scope, **new})
        on = F.lit(True)
        for v in shared:
            on = on & (col(v) == col(f"#{v}"))
            if len(frame.scope[v].tables) > 1:
                on = on & (col(f"{v}.{LABEL}").isin(*part.scope[v].tables))
        for e in where:
            if e not in inner:
                on = on & self.compiler(both).predicate(e)
        return df, on, both

    def optional(self, frame: Frame | None, paths: tuple, where: list) -> Frame:
        """Rows without a match stay, with NULLs; WHERE belongs to the match."""
        frame = self.unit(frame)
        df, on, both = self._part(frame, paths, where)
        joined = frame.df.join(df, on, "left").select(*[col(c) for c in both.df.columns if not c.startswith("#")])
        return Frame(joined, both.scope)

    # predicates

    def where(self, frame: Frame, where: list) -> Frame:
        for e in where:
            negated = isinstance(e, A.Unary) and e.op == "NOT" and isinstance(e.operand, A.Exists)
            if isinstance(e, A.Exists) or negated:
                df, on, _ = self._part(frame, *self._exists_parts(e.operand if negated else e))
                frame = frame.with_df(frame.df.join(df, on, "left_anti" if negated else "left_semi"))
            else:
                marked, e = self.marked(frame, e)
                frame = frame.with_df(marked.df.where(self.compiler(marked).predicate(e)).select(*[col(c) for c in frame.df.columns]))
        return frame

    @staticmethod
    def _exists_parts(e: A.Exists) -> tuple[tuple, list]:
        paths, where = (), []
        for c in e.clauses:
            if isinstance(c, A.Match) and not c.optional:
                paths += c.paths
                where += conjuncts(c.where)
            elif isinstance(c, A.Where):
                where += conjuncts(c.expr)
            elif not isinstance(c, A.Projection):
                raise BindError("EXISTS takes MATCH and WHERE")
        return paths, where

    def marked(self, frame: Frame, e: Any) -> tuple[Frame, Any]:
        """Each EXISTS inside e becomes a boolean column: the distinct rows of what it reads, those that match marked."""
        for x in [x for x in walk(e) if isinstance(x, A.Exists)]:
            paths, where = self._exists_parts(x)
            df, on, _ = self._part(frame, paths, where)
            asked = (*where, *self._inline(paths))
            reads = {v for v in (*pattern_variables(paths), *variables(asked)) if v in frame.scope}
            reads |= {f"{y.base.name}.{y.name}" for y in walk(asked) if isinstance(y, A.Prop) and isinstance(y.base, A.Var)} | {f"{v}.{LABEL}" for v in reads}
            columns = [c for c in frame.df.columns if c in reads]
            self.marks += 1
            mark = f"#exists{self.marks}"
            hit = frame.df.select(*map(col, columns)).distinct().join(df, on, "left_semi").select(*[col(c).alias(f"#k.{c}") for c in columns], F.lit(True).alias(mark))
            same = F.lit(True)
            for c in columns:
                same = same & col(c).eqNullSafe(col(f"#k.{c}"))
            joined = frame.df.join(hit, same, "left").withColumn(mark, F.coalesce(F.col(mark), F.lit(False))).drop(*[f"#k.{c}" for c in columns])
            frame = Frame(joined, {**frame.scope, mark: Binding("scalar")})
            e = rebuild(e, lambda y, x=x, mark=mark: A.Var(mark) if y is x or y == x else None)
        return frame, e

    def unwind(self, frame: Frame, c: A.Unwind) -> Frame:
        x = self.compiler(frame).typed(c.expr)
        if c.var in frame.scope:
            raise BindError(f"'{c.var}' is already bound")
        if is_null(x.type):
            x = Typed(x.col.cast("array<bigint>"), T.ArrayType(T.LongType()))
        if not isinstance(x.type, T.ArrayType):
            raise BindError("UNWIND takes a list")
        return Frame(frame.df.select("*", F.explode(x.col).alias(c.var)), {**frame.scope, c.var: Binding("scalar")})

    # projections

    def project(self, frame: Frame, p: A.Projection, keys: tuple) -> Frame:
        if not p.items:
            visible = [c for c in frame.df.columns if not c.startswith("#")]
            df = frame.df.orderBy(*[self._sorted(self.compiler(frame).typed(e).col, down) for e, down in keys]) if keys else frame.df
            df = df.select(*map(col, visible))
            return Frame(df.distinct() if p.distinct else df, frame.scope)
        if p.continues and any(i.alias is None and not isinstance(i.expr, A.Var) for i in p.items):
            p = replace(p, items=tuple(replace(i, alias=i.alias or default_name(i.expr)) for i in p.items))
        names, taken = [], {}
        for i in p.items:
            name = i.alias or default_name(i.expr)
            taken[name] = taken.get(name, 0) + 1
            names.append(name if taken[name] == 1 else f"{name}_{taken[name]}")
        if len(set(names)) < len(names) or (p.continues and any(n > 1 for n in taken.values())):
            raise BindError("a name is given twice")
        items = [i.expr for i in p.items]
        if any(isinstance(x, A.Exists) for x in walk(tuple(items))):
            marked = frame
            for k, e in enumerate(items):
                marked, items[k] = self.marked(marked, e)
            frame = marked
        if any(self._aggregates(e) for e in (*items, *[e for e, _ in keys])):
            return self._aggregated(frame, p, names, items, keys)
        columns, scope = [], {}
        for name, e in zip(names, items):
            columns += self._outputs(frame, name, e, scope, p.continues)
        if p.distinct:
            df = frame.df.select(*[c.alias(n) for n, c in columns]).distinct()
            out = Frame(df, scope)
            if keys:
                out = out.with_df(df.orderBy(*[self._sorted(self._after(out, names, items, e), down) for e, down in keys]))
            return out
        if not keys:
            return Frame(frame.df.select(*[c.alias(n) for n, c in columns]), scope)
        sorts = []
        for e, down in keys:  # an alias first, else what the projection reads from
            at = names.index(e.name) if isinstance(e, A.Var) and e.name in names else None
            sorts.append(self._sorted(self.compiler(frame).typed(items[at] if at is not None else e).col, down))
        return Frame(frame.df.orderBy(*sorts).select(*[c.alias(n) for n, c in columns]), scope)

    def _outputs(self, frame: Frame, name: str, e: Any, scope: dict[str, Binding], continues: bool) -> list[tuple[str, Any]]:
        """Columns of one item; a node or relationship that goes on keeps its properties."""
        if isinstance(e, A.Var) and e.name in frame.scope and frame.scope[e.name].kind != "scalar":
            if continues:
                scope[name] = frame.scope[e.name]
                return [(name + c[len(e.name) :], col(c)) for c in frame.columns_of(e.name)]
            scope[name] = Binding("scalar")
            return [(name, col(e.name))]
        x = self.compiler(frame).typed(e)
        scope[name] = Binding("scalar", path=x.path)
        return [(name, x.col)]

    def _after(self, out: Frame, names: list[str], items: list, e: Any):
        """A sort key over the projection's own columns."""
        by = {i: n for n, i in zip(names, items)}
        e = rebuild(e, lambda x: A.Var(by[x]) if not isinstance(x, (tuple, str)) and x in by else None)
        return self.compiler(out).typed(e).col

    @staticmethod
    def _aggregates(e: Any) -> list[A.Call]:
        return [x for x in walk(e) if isinstance(x, A.Call) and x.name in AGGREGATES]

    def _aggregated(self, frame: Frame, p: A.Projection, names: list[str], items: list, keys: tuple) -> Frame:
        """Items without aggregates are the grouping keys; aggregates inside expressions become columns of their own."""
        comp = self.compiler(frame)
        groups, scope, pre = {}, {}, []
        for k, e in enumerate(items):
            if not self._aggregates(e) and e not in groups:
                part: dict[str, Binding] = {}
                made = self._outputs(frame, f"#k{k}", e, part, p.continues)
                groups[e] = (f"#k{k}", [n for n, _ in made])
                scope.update(part)
                pre += [c.alias(n) for n, c in made]
        calls = list(dict.fromkeys(a for e in (*items, *[e for e, _ in keys]) for a in self._aggregates(e)))
        aggs = []
        for k, a in enumerate(calls):
            if any(self._aggregates(x) for x in a.args):
                raise BindError("aggregates can't be nested")
            arg = None
            if not a.star and a.args:
                arg = comp.typed(a.args[0])
                pre.append(arg.col.alias(f"#x{k}"))
                arg = Typed(F.col(f"#x{k}"), arg.type, arg.path)
            elif a.name != "count":
                raise BindError(f"{a.name}() takes an argument")
            made = aggregate(a.name, arg, a.distinct)
            aggs.append(made.col.alias(f"#a{k}"))
            scope[f"#a{k}"] = Binding("scalar", path=made.path)
        by = [col(c) for _, cs in groups.values() for c in cs]
        base = frame.df.select(*pre) if pre else frame.df.select(F.lit(1).alias("#one"))
        grouped = (base.groupBy(*by) if by else base).agg(*aggs) if aggs else base.distinct()
        after = Frame(grouped, scope)
        swap = {**{e: A.Var(g) for e, (g, _) in groups.items()}, **{a: A.Var(f"#a{k}") for k, a in enumerate(calls)}}

        def changed(e: Any) -> Any:
            return rebuild(e, lambda x: swap.get(x) if not isinstance(x, (tuple, str, dict, list)) and x in swap else None)

        columns, out_scope = [], {}
        for name, e in zip(names, items):
            columns += self._outputs(after, name, changed(e), out_scope, p.continues)
        if keys:
            sorts = []
            for e, down in keys:
                at = names.index(e.name) if isinstance(e, A.Var) and e.name in names else None
                sorts.append(self._sorted(self.compiler(after).typed(changed(items[at] if at is not None else e)).col, down))
            grouped = grouped.orderBy(*sorts)
        df = grouped.select(*[c.alias(n) for n, c in columns])
        return Frame(df.distinct() if p.distinct else df, out_scope)

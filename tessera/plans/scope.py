"""The running plan: a DataFrame and what its columns mean.

A node or relationship variable v is the column `v` (its id) with `v.prop` for each property; a variable that may stand
for nodes of several tables also has `v.#label`. A scalar is the column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.cypher import ast as A

LABEL = "#label"


@dataclass(frozen=True)
class Binding:
    """kind is node, rel or scalar; tables: the tables a node or relationship may come from."""

    kind: str
    tables: tuple[str, ...] = ()
    path: bool = False


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    scope: dict[str, Binding]

    def with_df(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def columns_of(self, var: str) -> list[str]:
        return [c for c in self.df.columns if c == var or c.startswith(var + ".")]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def rebuild(e: Any, change) -> Any:
    """e with change(x) in place of each inner expression x for which it isn't None; change sees outer ones first."""
    found = change(e)
    if found is not None:
        return found
    if isinstance(e, tuple):
        return tuple(rebuild(x, change) for x in e)
    if is_dataclass(e):
        return replace(e, **{f.name: rebuild(getattr(e, f.name), change) for f in fields(e)})
    return e


def walk(e: Any):
    """e and everything inside it."""
    yield e
    if isinstance(e, tuple):
        for x in e:
            yield from walk(x)
    elif is_dataclass(e):
        for f in fields(e):
            yield from walk(getattr(e, f.name))


def conjuncts(e: Any) -> list:
    if e is None:
        return []
    if isinstance(e, A.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def variables(e: Any) -> set[str]:
    """Names of outer variables that e reads."""
    if isinstance(e, A.Comprehension):
        return variables(e.source) | ((variables(e.where) | variables(e.result)) - {e.var})
    if isinstance(e, A.Var):
        return {e.name}
    if isinstance(e, tuple):
        return set().union(*map(variables, e)) if e else set()
    if is_dataclass(e):
        return set().union(*[variables(getattr(e, f.name)) for f in fields(e)])
    return set()


def pattern_variables(paths: tuple) -> set[str]:
    return {n.var for p in paths for n in p.nodes} | {r.var for p in paths for r in p.rels if r.var}


def default_name(e: Any) -> str:
    if isinstance(e, A.Var):
        return e.name
    if isinstance(e, A.Prop):
        return f"{default_name(e.base)}.{e.name}"
    if isinstance(e, A.Call):
        return e.name
    return "?column?"

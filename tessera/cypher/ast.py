"""Statements, clauses, patterns and expressions as parsed."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Prop:
    base: Any
    name: str


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Comprehension:
    var: str
    source: Any
    where: Any
    result: Any


@dataclass(frozen=True)
class Unary:
    op: str
    operand: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    operand: Any
    negated: bool


@dataclass(frozen=True)
class In:
    operand: Any
    items: Any
    negated: bool


@dataclass(frozen=True)
class Case:
    subject: Any
    whens: tuple
    default: Any


@dataclass(frozen=True)
class Cast:
    operand: Any
    to: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Exists:
    clauses: tuple


@dataclass(frozen=True)
class NodePat:
    var: str
    label: str | None
    props: tuple = ()


@dataclass(frozen=True)
class RelPat:
    """direction is '>', '<' or '-'; most None: any number of hops; varied: written with '*'."""

    var: str | None
    kind: str | None
    direction: str
    props: tuple = ()
    varied: bool = False
    least: int = 1
    most: int | None = 1


@dataclass(frozen=True)
class PathPat:
    """mode is '', 'shortest' or 'all'."""

    nodes: tuple
    rels: tuple
    name: str | None = None
    mode: str = ""


@dataclass(frozen=True)
class Item:
    expr: Any
    alias: str | None


@dataclass(frozen=True)
class Match:
    paths: tuple
    optional: bool
    where: Any = None


@dataclass(frozen=True)
class Where:
    expr: Any


@dataclass(frozen=True)
class Projection:
    """RETURN, or WITH if `continues`; no items: '*'."""

    items: tuple
    distinct: bool
    continues: bool


@dataclass(frozen=True)
class OrderBy:
    keys: tuple


@dataclass(frozen=True)
class Skip:
    count: Any


@dataclass(frozen=True)
class Limit:
    count: Any


@dataclass(frozen=True)
class Unwind:
    expr: Any
    var: str


@dataclass(frozen=True)
class Subquery:
    clauses: tuple


@dataclass(frozen=True)
class Create:
    paths: tuple


@dataclass(frozen=True)
class SetProps:
    items: tuple


@dataclass(frozen=True)
class Delete:
    targets: tuple
    detach: bool


@dataclass(frozen=True)
class Merge:
    node: NodePat
    on_create: tuple
    on_match: tuple


@dataclass(frozen=True)
class Query:
    clauses: tuple


@dataclass(frozen=True)
class Union:
    left: Any
    right: Any
    every: bool


@dataclass(frozen=True)
class CallProcedure:
    name: str
    args: tuple
    yields: tuple


@dataclass(frozen=True)
class CopyFrom:
    table: str
    path: str
    header: bool
    delimiter: str


@dataclass(frozen=True)
class CopyTo:
    source: Any
    path: str
    header: bool
    delimiter: str


@dataclass(frozen=True)
class CreateNodeTable:
    name: str
    columns: tuple
    key: str


@dataclass(frozen=True)
class CreateRelTable:
    name: str
    source: str
    target: str
    columns: tuple


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class AlterTable:
    """action is add, drop, rename or rename_column; names are its arguments."""

    name: str
    action: str
    names: tuple = field(default=())

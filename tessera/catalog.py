"""Node and relationship tables: their metadata and their rows."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.errors import BindError
from tessera.types import DECLARED


@dataclass(frozen=True)
class Part:
    """Rows that were appended together, their number (None: not counted) and the folder that holds them, if one does."""

    rows: DataFrame
    count: int | None
    path: str | None = None


@dataclass(frozen=True)
class Parts:
    """What a table's rows are made of. It holds for `whole` alone: rows that were changed otherwise are one new part."""

    whole: DataFrame
    each: tuple[Part, ...]


def parts_of(table: NodeTable | RelTable) -> tuple[Part, ...]:
    return table.parts.each if table.parts and table.parts.whole is table.rows else (Part(table.rows, None),)


def of_parts(each: tuple[Part, ...]) -> tuple[DataFrame, Parts]:
    whole = each[0].rows
    for p in each[1:]:
        whole = whole.unionByName(p.rows)
    return whole, Parts(whole, each)


@dataclass(frozen=True)
class NodeTable:
    """rows: _id (the node's offset) and the columns. serial: counters of SERIAL columns. next_id: the next free offset."""

    id: int
    name: str
    key: str
    columns: dict[str, T.DataType]
    rows: DataFrame
    next_id: int | None = 0
    serial: dict[str, int] = field(default_factory=dict)
    parts: Parts | None = field(default=None, compare=False)
    kind = "NODE"


@dataclass(frozen=True)
class RelTable:
    """rows: _rid, _src, _dst and the columns; _src and _dst are offsets in the source and target tables."""

    id: int
    name: str
    source: str
    target: str
    columns: dict[str, T.DataType]
    rows: DataFrame
    next_id: int | None = 0
    parts: Parts | None = field(default=None, compare=False)
    kind = "REL"


@dataclass(frozen=True)
class Catalog:
    """An immutable version of all tables; names are unique across both kinds. Writes make another version. applied: the last
    batch of each stream that is in the tables."""

    tables: dict[str, NodeTable | RelTable] = field(default_factory=dict)
    next_table: int = 0
    applied: dict[str, int] = field(default_factory=dict)

    def put(self, table: NodeTable | RelTable) -> Catalog:
        return replace(self, tables={**self.tables, table.name: table}, next_table=max(self.next_table, table.id + 1))

    def free(self, name: str) -> None:
        if name in self.tables:
            raise BindError(f"table '{name}' already exists")

    def get(self, name: str) -> NodeTable | RelTable:
        if name not in self.tables:
            raise BindError(f"unknown table '{name}'")
        return self.tables[name]

    def node(self, name: str) -> NodeTable:
        found = self.get(name)
        if not isinstance(found, NodeTable):
            raise BindError(f"'{name}' is not a node table")
        return found

    def rel(self, name: str) -> RelTable:
        found = self.get(name)
        if not isinstance(found, RelTable):
            raise BindError(f"'{name}' is not a relationship table")
        return found

    def nodes(self) -> list[NodeTable]:
        return sorted((t for t in self.tables.values() if isinstance(t, NodeTable)), key=lambda t: t.id)

    def rels(self) -> list[RelTable]:
        return sorted((t for t in self.tables.values() if isinstance(t, RelTable)), key=lambda t: t.id)

    def drop(self, name: str) -> Catalog:
        table = self.get(name)
        users = [r.name for r in self.rels() if name in (r.source, r.target)]
        if isinstance(table, NodeTable) and users:
            raise BindError(f"table '{name}' is referenced by {', '.join(users)}")
        return replace(self, tables={k: v for k, v in self.tables.items() if k != name})

    def rename(self, old: str, new: str) -> Catalog:
        self.free(new)
        moved = {}
        for t in self.tables.values():
            if isinstance(t, RelTable):
                t = replace(t, source=new if t.source == old else t.source, target=new if t.target == old else t.target)
            if t.name == old:
                t = replace(t, name=new)
            moved[t.name] = t
        return replace(self, tables=moved)


def declared(columns: tuple) -> dict[str, T.DataType]:
    out = {}
    for name, kind in columns:
        if name in out:
            raise BindError(f"duplicate column '{name}'")
        out[name] = DECLARED[kind]
    return out

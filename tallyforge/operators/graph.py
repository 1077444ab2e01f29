"""Schemas as small driver-side graphs: tables, foreign keys, neighbourhood partitions and the universal relation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product


@dataclass(frozen=True)
class TableDef:
    name: str
    columns: tuple[str, ...]
    key: str | None = None
    casts: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class FkDef:
    """``child.fk`` refers to ``parent.pk``."""

    parent: str
    pk: str
    child: str
    fk: str

    @property
    def condition(self) -> str:
        return f"{self.parent}.{self.pk}={self.child}.{self.fk}"

    def column_of(self, table: str) -> str:
        return self.pk if table == self.parent else self.fk

    def other(self, table: str) -> str:
        return self.child if table == self.parent else self.parent


@dataclass(frozen=True)
class SubSchema:
    """A tree of tables that one model covers. center: the referring table; empty for the universal relation."""

    name: str
    center: str
    tables: tuple[str, ...]
    edges: tuple[FkDef, ...]
    casts: dict[str, str] = field(default_factory=dict, compare=False)

    @property
    def root(self) -> str:
        return self.center or self.tables[0]


class SchemaError(ValueError):
    pass


class Schema:
    """Tables and foreign keys; two keys between the same tables are allowed."""

    def __init__(self, name: str, lower: bool = False) -> None:
        self.name, self.lower = name, lower
        self.tables: dict[str, TableDef] = {}
        self.fks: list[FkDef] = []

    def _case(self, x: str) -> str:
        return x.lower() if self.lower else x

    def add_table(self, name: str, columns: Iterable[str], key: str | None = None, casts: dict[str, str] | None = None) -> Schema:
        name = self._case(name)
        if name in self.tables:
            raise SchemaError(f"table {name} is there already")
        self.tables[name] = TableDef(
            name, tuple(map(self._case, columns)), key and self._case(key), tuple((self._case(k), v) for k, v in (casts or {}).items())
        )
        return self

    def add_relationship(self, parent: str, pk: str, child: str, fk: str) -> Schema:
        made = FkDef(*map(self._case, (parent, pk, child, fk)))
        for t in (made.parent, made.child):
            if t not in self.tables:
                raise SchemaError(f"no table {t}")
        self.fks.append(made)
        return self

    def edges_between(self, a: str, b: str) -> list[FkDef]:
        return [e for e in self.fks if {e.parent, e.child} == {a, b}]

    def declared(self, left: tuple[str, str], right: tuple[str, str]) -> FkDef | None:
        """The foreign key that the equation of two (table, column) pairs states, in either order."""
        for e in self.fks:
            if {left, right} == {(e.parent, e.pk), (e.child, e.fk)}:
                return e
        return None

    def paths(self, a: str, b: str) -> Iterator[list[str]]:
        """Simple paths over tables from a to b, shortest first."""
        todo = deque([[a]])
        while todo:
            path = todo.popleft()
            if path[-1] == b:
                yield path
                continue
            for n in sorted({e.other(path[-1]) for e in self.fks if path[-1] in (e.parent, e.child)} - set(path)):
                todo.append([*path, n])

    def fk_columns(self, table: str) -> list[str]:
        """Columns of ``table`` that refer to others; one entry for each key, parallel ones included."""
        return [e.fk for e in self.fks if e.child == table]

    # ---- partitions ----------------------------------------------------------------------------------------------

    def neighbourhoods(self) -> list[SubSchema]:
        """Every referring table with all tables it refers to; one partition for each choice among parallel keys."""
        out = []
        for center in self.tables:
            parents: dict[str, list[FkDef]] = {}
            for e in self.fks:
                if e.child == center:
                    parents.setdefault(e.parent, []).append(e)
            for chosen in product(*parents.values()) if parents else ():
                name = center + "".join(sorted(f":{e.fk}={e.parent}.{e.pk}" for e in chosen))
                tables = (center, *(e.parent for e in chosen))
                out.append(SubSchema(name, center, tables, tuple(chosen), self._casts(tables)))
        return out

    def universal(self, drop: Iterable[FkDef] = ()) -> SubSchema:
        """The whole schema as one tree; keys in ``drop`` are left out (a cyclic schema needs that)."""
        dropped = set(drop)
        edges = tuple(e for e in self.fks if e not in dropped)
        names = tuple(self.tables)
        sub = SubSchema("universal", "", names, edges, self._casts(names))
        if not is_tree(names, edges):
            raise SchemaError("the universal relation needs a connected schema without cycles")
        return sub

    def _casts(self, tables: Iterable[str]) -> dict[str, str]:
        """Of all tables together, and the existence markers."""
        found = {f"__in__:{t}": "boolean" for t in tables}
        for t in tables:
            found |= {f"{t}.{c}": kind for c, kind in self.tables[t].casts}
        return found

    def hypergraph(self) -> dict[str, frozenset[str]]:
        """Partitions as sets of tables."""
        return {s.name: frozenset(s.tables) for s in self.neighbourhoods()}

    def dot(self) -> str:
        """Graphviz text of the schema."""
        lines = [f'  "{e.parent}" -> "{e.child}" [label="{e.condition}"];' for e in self.fks]
        return "digraph schema {\n" + "\n".join([*(f'  "{t}";' for t in self.tables), *lines]) + "\n}\n"


def adjacency(edges: Iterable[FkDef]) -> dict[str, list[tuple[FkDef, str]]]:
    out: dict[str, list[tuple[FkDef, str]]] = {}
    for e in edges:
        out.setdefault(e.parent, []).append((e, e.child))
        out.setdefault(e.child, []).append((e, e.parent))
    return out


def breadth_first(root: str, edges: Iterable[FkDef]) -> list[tuple[str, FkDef | None, str | None]]:
    """(table, edge to its parent in the search, that parent), root first."""
    near = adjacency(edges)
    out: list[tuple[str, FkDef | None, str | None]] = [(root, None, None)]
    seen, k = {root}, 0
    while k < len(out):
        at = out[k][0]
        k += 1
        for e, n in near.get(at, ()):
            if n not in seen:
                seen.add(n)
                out.append((n, e, at))
    return out


def is_tree(tables: Iterable[str], edges: Iterable[FkDef]) -> bool:
    names, edges = list(tables), list(edges)
    return bool(names) and len(edges) == len(names) - 1 and len(breadth_first(names[0], edges)) == len(names)

"""A schema with its tables: exact answers, and the plan of a query over the schema's tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import Predicate, conjunction, normalize
from ..operators.graph import FkDef, Schema, SchemaError, is_tree
from ..operators.statistics import count_by_messages, name
from .sqlparse import SpjQuery, parse


@dataclass(frozen=True)
class Bound:
    """A query on the schema: its tables (added ones included), declared edges and predicates."""

    tables: tuple[str, ...]
    edges: tuple[FkDef, ...]
    predicates: tuple[Predicate, ...]
    added: tuple[str, ...] = ()


class Database:
    def __init__(self, spark: SparkSession, schema: Schema, tables: dict[str, DataFrame]) -> None:
        self.spark, self.schema, self.tables = spark, schema, tables

    def views(self) -> Database:
        for t, df in self.tables.items():
            df.createOrReplaceTempView(t)
        return self

    def parse(self, sql: str) -> SpjQuery:
        return parse(sql, lower=self.schema.lower)

    # ---- exact ---------------------------------------------------------------------------------------------------

    def filtered(self, table: str, predicates: tuple[Predicate, ...]) -> DataFrame:
        mine = [p for p in predicates if p.table == table]
        df = self.tables[table]
        return df.where(conjunction(mine, lambda p: name(p.column))) if mine else df

    def count(self, query: SpjQuery | str) -> DataFrame:
        """COUNT(*) of any query of the dialect, cycles and undeclared joins included. One row: cnt."""
        q = self.parse(query) if isinstance(query, str) else query
        needed = {(t, c) for j in q.joins for t, c in j}
        todo = [self.filtered(t, q.predicates).select(*[name(c).alias(f"{t}.{c}") for tt, c in sorted(needed) if tt == t]) for t in q.tables]
        left, *rest = list(zip(q.tables, todo, strict=True))
        done, df = {left[0]}, left[1]
        while rest:
            k = next((i for i, (t, _) in enumerate(rest) if self._joins(q, done, t)), 0)
            t, more = rest.pop(k)
            on = [name(f"{a}.{ac}") == name(f"{b}.{bc}") for (a, ac), (b, bc) in self._joins(q, done, t)]
            df = df.join(more, on, "inner") if on else df.crossJoin(more)
            done.add(t)
        extra = [j for j in q.joins if j[0][0] == j[1][0]]
        for (t, a), (_, b) in extra:
            df = df.where(name(f"{t}.{a}") == name(f"{t}.{b}"))
        return df.agg(F.count(F.lit(1)).alias("cnt"))

    @staticmethod
    def _joins(q: SpjQuery, done: set[str], table: str) -> list:
        return [j for j in q.joins if {j[0][0], j[1][0]} - {table} and {j[0][0], j[1][0]} - {table} <= done and table in (j[0][0], j[1][0])]

    def count_messages(self, query: SpjQuery | str) -> DataFrame:
        """COUNT(*) of a query over declared keys that form a tree, from sums by key, without the join. One row: cnt.

        Two columns that refer to one key are joined through its table, which holds each key once: that leaves the count as
        it is where no key dangles. Other tables in between would change it.
        """
        b = self.bind(query)
        if any(sum(t == e.parent for e in b.edges) < 2 or any(t == e.child for e in b.edges) for t in b.added):
            raise SchemaError("a table that is not in the query would change the count")
        tables = {t: self.filtered(t, b.predicates) for t in b.tables}
        return count_by_messages(tables, b.edges, b.tables[0])

    # ---- binding -------------------------------------------------------------------------------------------------

    def bind(self, query: SpjQuery | str) -> Bound:
        """Joins as declared keys. Two columns that both refer to one key are joined through its table, which is added
        where the query lacks it (right where no key dangles; estimates only). The result must be a tree."""
        q = self.parse(query) if isinstance(query, str) else query
        for t in q.tables:
            if t not in self.schema.tables:
                raise SchemaError(f"no table {t}")
        tables, edges, added = list(q.tables), [], []
        for left, right in q.joins:
            e = self.schema.declared(left, right)
            if e:
                edges.append(e)
                continue
            through = self._through(left, right)
            if not through:
                raise SchemaError(f"{left} = {right} is no declared key")
            for e in through:
                edges.append(e)
                for t in (e.parent, e.child):
                    if t not in tables:
                        tables.append(t)
                        added.append(t)
        edges = list(dict.fromkeys(edges))
        if not is_tree(tables, edges):
            raise SchemaError("the query's joins are no tree")
        return Bound(tuple(tables), tuple(edges), tuple(normalize(q.predicates)), tuple(added))

    def _through(self, left: tuple[str, str], right: tuple[str, str]) -> list[FkDef]:
        """Keys that join two columns through other tables, over the shortest path on which one value is handed on: every
        edge of a path takes the column that the edge before it gave, so both columns hold keys of one table in the end."""
        for path in self.schema.paths(left[0], right[0]):
            edges, column = [], left[1]
            for a, b in zip(path, path[1:], strict=False):
                e = next((e for e in self.schema.edges_between(a, b) if e.column_of(a) == column), None)
                if e is None:
                    break
                edges.append(e)
                column = e.column_of(b)
            else:
                if len(edges) > 1 and column == right[1]:
                    return edges
        return []

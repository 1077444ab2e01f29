"""Predicates of a conjunctive query as values, and as Spark conditions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = (
    ">", "<", ">=", "<=", "=", "!=", "IN", "NOT IN", "BETWEEN", "IS", "IS NOT", "LIKE", "NOT LIKE", "ALL_TRUE", "ALL_FALSE",
)
SETLIKE = ("IN", "NOT IN", "LIKE", "NOT LIKE")
RANGES = (">", "<", ">=", "<=")


@dataclass(frozen=True)
class Predicate:
    """``table.column op value``. value: a literal, a tuple (IN, BETWEEN), or None for NULL."""

    table: str
    column: str
    op: str
    value: Any = None

    def __post_init__(self) -> None:
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op}")

    @property
    def name(self) -> str:
        return f"{self.table}.{self.column}"


def like(c: Column, pattern: str) -> Column:
    """SQL LIKE without an escape character: % and _ are wild, all else stands for itself."""
    escape = next(e for e in "\\\x01\x02\x03!" if e not in pattern)
    return F.like(c, F.lit(pattern), F.lit(escape))


_CONDITIONS: dict[str, Callable[[Column, Any], Column]] = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c.isNull() if v is None else c == v,  # the dialect's "= NULL" is IS NULL
    "!=": lambda c, v: c.isNotNull() if v is None else c != v,
    "IN": lambda c, v: c.isin(*v) if v else F.lit(False),
    "NOT IN": lambda c, v: ~c.isin(*v) if v else c.isNotNull(),
    "BETWEEN": lambda c, v: c.between(*v),
    "IS": lambda c, v: c.isNull() if v is None else c.eqNullSafe(v),
    "IS NOT": lambda c, v: c.isNotNull() if v is None else ~c.eqNullSafe(v),
    "LIKE": like,
    "NOT LIKE": lambda c, v: ~like(c, v),
    "ALL_TRUE": lambda c, v: F.lit(True),
    "ALL_FALSE": lambda c, v: F.lit(False),
}


def literal(v: Any) -> Any:
    return F.lit(v) if isinstance(v, (date, datetime)) else v


def condition(p: Predicate, column: Column) -> Column:
    """The Spark condition of one predicate; null values never match but where the predicate asks for them."""
    value = tuple(map(literal, p.value)) if isinstance(p.value, (tuple, list)) else literal(p.value)
    return _CONDITIONS[p.op](column, value)


def conjunction(predicates: Iterable[Predicate], column: Callable[[Predicate], Column]) -> Column:
    return reduce(lambda a, b: a & b, (condition(p, column(p)) for p in predicates), F.lit(True))


def merged(predicates: Iterable[Predicate], strict: bool = False) -> list[Predicate]:
    """The IN lists of a column as one: what they have in common; what its NOT IN lists name goes from it, or else into one
    list. LIKE patterns stay: they are evaluated on the dictionary. strict: a column with lists or patterns may not have a
    range beside them (ValueError)."""
    out: list[Predicate] = []
    by: dict[str, list[Predicate]] = {}
    for p in predicates:
        by.setdefault(p.name, []).append(p)
    for c, ps in by.items():
        sets, ranges = [p for p in ps if p.op in SETLIKE], [p for p in ps if p.op in RANGES]
        if strict and sets and ranges:
            raise ValueError(f"{c} has both {sets[0].op} and {ranges[0].op}")
        lists, without = [p for p in ps if p.op == "IN"], [p for p in ps if p.op == "NOT IN"]
        barred = list(dict.fromkeys(v for p in without for v in p.value))
        if len(lists) + len(without) < 2:
            out += ps
            continue
        if lists:
            kept = [v for v in dict.fromkeys(lists[0].value) if all(v in p.value for p in lists[1:]) and v not in barred]
            out.append(Predicate(lists[0].table, lists[0].column, "IN", tuple(kept)))
        elif without:
            out.append(Predicate(without[0].table, without[0].column, "NOT IN", tuple(barred)))
        out += [p for p in ps if p.op not in ("IN", "NOT IN")]
    return out


def normalize(predicates: Iterable[Predicate]) -> list[Predicate]:
    """One form for each meaning: BETWEEN becomes two bounds, comparisons with NULL become IS, a column's lists become one;
    repeated ones go."""
    out: list[Predicate] = []
    for p in predicates:
        if p.op == "BETWEEN":
            made = [Predicate(p.table, p.column, ">=", p.value[0]), Predicate(p.table, p.column, "<=", p.value[1])]
        elif p.value is None and p.op in ("=", "!="):
            made = [Predicate(p.table, p.column, "IS" if p.op == "=" else "IS NOT")]
        else:
            made = [p]
        out += [m for m in made if m not in out]
    return merged(out)


def split_by_tables(predicates: Iterable[Predicate], tables: Iterable[str]) -> tuple[list[Predicate], list[Predicate]]:
    """Those on ``tables``, and the rest."""
    names = set(tables)
    inside = [p for p in predicates if p.table in names]
    return inside, [p for p in predicates if p.table not in names]


def sql_of(p: Predicate, column: str) -> str:
    """The predicate in SQL."""
    def lit(v: Any) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, datetime):
            return f"TIMESTAMP '{v:%Y-%m-%d %H:%M:%S}'"
        if isinstance(v, date):
            return f"DATE '{v}'"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    if p.op in ("ALL_TRUE", "ALL_FALSE"):
        return p.op[4:]
    if p.op in ("IN", "NOT IN"):
        return f"{column} {p.op} ({', '.join(map(lit, p.value))})" if p.value else ("FALSE" if p.op == "IN" else f"{column} IS NOT NULL")
    if p.op == "BETWEEN":
        return f"{column} BETWEEN {lit(p.value[0])} AND {lit(p.value[1])}"
    if p.value is None:
        return f"{column} IS {'NOT ' if p.op in ('!=', 'IS NOT') else ''}NULL"
    if p.op in ("IS", "IS NOT"):
        return f"{column} IS {'NOT ' * (p.op == 'IS')}DISTINCT FROM {lit(p.value)}"
    return f"{column} {'<>' if p.op == '!=' else p.op} {lit(p.value)}"

"""Estimates of COUNT(*) over a universal relation, or over neighbourhoods chained by common tables.

Both have an exact form, in which the density is the data itself and the result equals the count, and a sampled form,
whose density is the empirical one of a weighted join sample.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Predicate, conjunction
from ..operators.graph import FkDef, SubSchema, adjacency
from ..operators.sampling import sample_join
from ..operators.statistics import away, fk_value_counts, full_outer_join, name, reachable_size
from .database import Bound, Database


def existence(tables: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for t in tables:
        out = out & name(f"__in__:{t}")
    return out


def qualifies(b: Bound, tables: tuple[str, ...] | None = None) -> Column:
    """Rows of a joined relation that really come from the query's tables and meet its predicates."""
    names = tables or b.tables
    mine = [p for p in b.predicates if p.table in names]
    return existence(tuple(names)) & F.coalesce(conjunction(mine, lambda p: name(p.name)), F.lit(False))


def boundary(edges: tuple[FkDef, ...], used: tuple[str, ...]) -> list[tuple[FkDef, str]]:
    """Edges with one end in ``used``, and that end."""
    return [(e, t) for e in edges for t in (e.parent, e.child) if t in used and e.other(t) not in used]


# ---- universal relation ------------------------------------------------------------------------------------------------


def _with_aways(db: Database, rows: DataFrame, sub: SubSchema, used: tuple[str, ...]) -> DataFrame:
    """Adds __scale__: by how many rows of the relation each combination of the used tables stands, over all boundary edges."""
    scale = F.lit(1.0)
    for k, (e, t) in enumerate(boundary(sub.edges, used)):
        found = away(db.tables, sub.edges, e, t).select(F.col("key").alias(f"_k{k}"), F.col("w").cast("double").alias(f"_w{k}"))
        rows = rows.join(found, name(f"{t}.{e.column_of(t)}") == F.col(f"_k{k}"), "left")
        scale = scale * F.coalesce(f"_w{k}", F.lit(1.0))
    return rows.withColumn("__scale__", scale)


def universal_exact(db: Database, sub: SubSchema, query: str) -> DataFrame:
    """Sum over the full outer join of 1 / scale where the query's tables are and its predicates hold. One row: cnt."""
    b = db.bind(query)
    rows = full_outer_join(db.tables, sub.edges, sub.root).where(qualifies(b))
    return _with_aways(db, rows, sub, b.tables).agg(F.coalesce(F.round(F.sum(1 / F.col("__scale__"))), F.lit(0.0)).cast("long").alias("cnt"))


def universal_sampled(db: Database, sub: SubSchema, query: str, sample: DataFrame | None = None, n: int = 100_000, seed: int = 1234) -> DataFrame:
    """Size of the relation times the sample's mean of (qualifies / scale), rounded up. One row: estimate."""
    b = db.bind(query)
    rows = sample if sample is not None else sample_join(db.tables, sub.edges, sub.root, n, seed)
    size = reachable_size(db.tables, sub.edges, sub.root).first()["size"]
    scaled = _with_aways(db, rows, sub, b.tables)
    mean = F.avg(F.when(qualifies(b), 1 / F.col("__scale__")).otherwise(0.0))
    return scaled.agg(F.ceil(F.coalesce(mean, F.lit(0.0)) * F.lit(float(size))).cast("long").alias("estimate"))


# ---- neighbourhoods ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Link:
    """A neighbourhood of the plan, the table it shares with the one before, and its key to that table."""

    sub: SubSchema
    tables: tuple[str, ...]
    common: str | None
    edge: FkDef | None


def neighbourhood_plan(db: Database, b: Bound) -> list[Link]:
    """Neighbourhoods that own an edge of the query, from the largest on (by name among equals), each joined to an
    earlier one by a common table; tables the query lacks are left out. One table alone takes the smallest that has it."""
    subs = db.schema.neighbourhoods()
    if not b.edges:
        able = [s for s in subs if b.tables[0] in s.tables]
        if not able:
            return []
        best = min(able, key=lambda s: (len(s.tables), s.name))
        return [Link(best, b.tables, None, None)]
    owned = []
    left = list(b.edges)
    for s in sorted(subs, key=lambda s: (-len(set(s.edges) & set(b.edges)), s.name)):
        mine = [e for e in left if e in s.edges]
        if mine:
            left = [e for e in left if e not in mine]
            owned.append((s, tuple(t for t in s.tables if any(t in (e.parent, e.child) for e in mine)), mine))
    if left:
        raise ValueError(f"no neighbourhood has {left[0].condition}")
    owned.sort(key=lambda x: (-len(x[1]), x[0].name))
    plan = [Link(owned[0][0], owned[0][1], None, None)]
    rest = owned[1:]
    while rest:
        for k, (s, tables, mine) in enumerate(rest):
            common = next((t for t in sorted(tables) if any(t in link.tables for link in plan)), None)
            if common:
                e = next((e for e in mine if common == e.parent), None)
                plan.append(Link(s, tables, common, e))
                rest.pop(k)
                break
        else:
            raise ValueError("the query's neighbourhoods don't hang together")
    return plan


def _star(db: Database, center: str, edges: list[FkDef], b: Bound, keep: set[str]) -> DataFrame:
    """The neighbourhood's center with its used parents, predicates applied as a 0/1 column __ok__."""
    tables = {t: db.tables[t] for t in {center, *(e.parent for e in edges)}}
    rows = full_outer_join(tables, edges, center).where(name(f"__in__:{center}"))
    needed = sorted(c for c in rows.columns if c in keep)
    ok = qualifies(b, tuple(t for t in tables if t in b.tables))
    return rows.select(*[name(c) for c in needed], F.when(ok, 1.0).otherwise(0.0).alias("__ok__"))


def neighbourhood_exact(db: Database, query: str) -> DataFrame:
    """Chains neighbourhoods: each multiplies by the fanout of the common table's key and the share of its rows that qualify given the key.

    Exact, as fanout times share is the number of qualifying rows of that key. One row: cnt.
    """
    b = db.bind(query)
    if not b.edges:
        return _one_table_exact(db, b)
    near = adjacency(b.edges)

    def chained(center_via: tuple[str, FkDef | None]) -> DataFrame:
        """Rows of a table with __p__: expected number of qualifying combinations below each."""
        table, via = center_via
        mine = [e for e, _ in near[table] if e != via]
        up = [e for e in mine if e.child == table]
        down = [e for e in mine if e.parent == table]
        keep = {f"{table}.{e.column_of(table)}" for e in [*mine, *([via] if via else [])]}
        keep |= {f"{e.parent}.{f.column_of(e.parent)}" for e in up for f, _ in near[e.parent]}
        rows = _star(db, table, up, b, keep).withColumn("__p__", F.col("__ok__"))
        for e in down:
            rows = _times(rows, f"{table}.{e.pk}", e, chained((e.child, e)))
        for e in up:  # the parent's other neighbourhoods, through the common table
            for f in [f for f, _ in near[e.parent] if f != e]:
                rows = _times(rows, f"{e.parent}.{f.column_of(e.parent)}", f, chained((f.other(e.parent), f)))
        return rows

    def _times(rows: DataFrame, key: str, e: FkDef, below: DataFrame) -> DataFrame:
        far = next(c for c in (f"{e.child}.{e.fk}", f"{e.parent}.{e.pk}") if c in below.columns and c != key)
        by_key = below.where(name(far).isNotNull()).groupBy(name(far).alias("_key")).agg(F.count(F.lit(1)).cast("double").alias("_fanout"), F.avg("__p__").alias("_share"))
        kept = [c for c in rows.columns if c != "__p__"]
        return rows.join(by_key, name(key) == F.col("_key"), "left").select(
            *[name(c) for c in kept], (F.col("__p__") * F.coalesce(F.col("_fanout") * F.col("_share"), F.lit(0.0))).alias("__p__")
        )

    root = neighbourhood_plan(db, b)[0].sub.center
    return chained((root, None)).agg(F.coalesce(F.round(F.sum("__p__")), F.lit(0.0)).cast("long").alias("cnt"))


def _one_table_exact(db: Database, b: Bound) -> DataFrame:
    """One table through the smallest neighbourhood that has it: each of its rows stands there once for every referring row,
    and is divided by that fanout. A table that no key names is counted as it is."""
    plan = neighbourhood_plan(db, b)
    (table,) = b.tables
    if not plan:
        return db.filtered(table, b.predicates).agg(F.count(F.lit(1)).alias("cnt"))
    sub = plan[0].sub
    rows = full_outer_join(db.tables, sub.edges, sub.center).where(qualifies(b))
    share = F.lit(1.0)
    if table != sub.center:
        e = next(e for e in sub.edges if e.parent == table)
        fan = fk_value_counts(db.tables[sub.center], e.fk).toDF("_key", "_n")
        rows = rows.join(fan, name(f"{table}.{e.pk}") == F.col("_key"), "left")
        share = 1 / F.coalesce("_n", F.lit(1)).cast("double")
    return rows.agg(F.coalesce(F.round(F.sum(share)), F.lit(0.0)).cast("long").alias("cnt"))


def neighbourhood_sampled(db: Database, query: str, n: int = 100_000, seed: int = 1234) -> DataFrame:
    """As the exact form, with every share taken from a join sample of its neighbourhood. One row: estimate.

    The shares are conditioned on the common key where the sample has it, else taken over the whole sample.
    """
    b = db.bind(query)
    plan = neighbourhood_plan(db, b)
    if not plan:
        (table,) = b.tables
        rows = db.tables[table]
        mean = F.avg(F.when(conjunction(b.predicates, lambda p: name(p.column)), 1.0).otherwise(0.0))
        return rows.agg(F.ceil(mean * F.count(F.lit(1))).cast("long").alias("estimate"))
    first = plan[0]
    size = reachable_size(db.tables, first.sub.edges, first.sub.root).first()["size"]
    held = sample_join({t: db.tables[t] for t in first.sub.tables}, first.sub.edges, first.sub.root, n, seed)
    held = held.withColumn("__p__", F.when(qualifies(b, tuple(t for t in first.tables if t in b.tables)), 1.0).otherwise(0.0))
    if not b.edges:
        center = first.sub.center
        if b.tables[0] != center:  # a referred table: its rows stand once for each referring one
            fan = away(db.tables, first.sub.edges, next(e for e in first.sub.edges if e.parent == b.tables[0]), b.tables[0])
            e = next(e for e in first.sub.edges if e.parent == b.tables[0])
            held = held.join(fan, name(f"{b.tables[0]}.{e.pk}") == F.col("key"), "left").withColumn("__p__", F.col("__p__") / F.coalesce(F.col("w").cast("double"), F.lit(1.0)))
    for link in plan[1:]:
        e = link.edge or next(e for e in link.sub.edges if link.common in (e.parent, e.child))
        key = f"{link.common}.{e.column_of(link.common)}"
        own = sample_join({t: db.tables[t] for t in link.sub.tables}, link.sub.edges, link.sub.root, n, seed)
        tables = tuple(t for t in link.tables if t in b.tables and t != link.common)
        ok = F.when(qualifies(b, tables), 1.0).otherwise(0.0)
        far = f"{e.child}.{e.fk}" if e.parent == link.common else f"{e.parent}.{e.pk}"
        shares = own.where(name(far).isNotNull()).groupBy(name(far).alias("_key")).agg(F.avg(ok).alias("_share"))
        overall = own.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("_overall"))
        counts = db.tables[e.child].where(name(e.fk).isNotNull()).groupBy(name(e.fk).alias("_fk")).agg(F.count(F.lit(1)).cast("double").alias("_fanout"))
        times = F.coalesce("_share", F.col("_overall"))
        held = held.join(shares, name(key) == F.col("_key"), "left").crossJoin(F.broadcast(overall))  # one row
        if e.parent == link.common:
            held = held.join(counts, name(key) == F.col("_fk"), "left")
            times = times * F.coalesce("_fanout", F.lit(0.0))
        held = held.withColumn("__p__", F.col("__p__") * times).drop("_key", "_share", "_overall", "_fk", "_fanout")
    return held.agg(F.ceil(F.coalesce(F.avg("__p__"), F.lit(0.0)) * F.lit(float(size))).cast("long").alias("estimate"))


ORDERS = ("prop", "prop-inv", "prop-ratio", "domain-size", "nat", "inv")


def ordered(counts: dict[str, tuple[int, int]], order: str, natural: list[str]) -> list[str]:
    """Columns with (matching values, size of the domain) in the order an estimator conditions on them: by matching values
    (prop), by the reverse, by their share of the domain (prop-ratio), by domain size, by nature (position), or the reverse."""
    place = {c: k for k, c in enumerate(natural)}
    keys = {
        "prop": lambda c: counts[c][0], "prop-inv": lambda c: -counts[c][0], "prop-ratio": lambda c: counts[c][0] / max(1, counts[c][1]), "domain-size": lambda c: counts[c][1],
        "nat": lambda c: place.get(c, len(place)), "inv": lambda c: -place.get(c, len(place)),
    }
    if order not in keys:
        raise ValueError(f"unknown order {order}; known: {', '.join(ORDERS)}")
    return sorted(counts, key=lambda c: (keys[order](c), place.get(c, len(place)), c))


def predicate_order(db: Database, predicates: list[Predicate], order: str = "prop-ratio", schema_order: list[str] | None = None) -> list[str]:
    """``ordered`` for the predicates' columns, over the tables themselves: one small aggregation a column, where the order needs it."""
    by: dict[str, list[Predicate]] = {}
    for p in predicates:
        by.setdefault(p.name, []).append(p)
    natural = schema_order or [f"{t.name}.{c}" for t in db.schema.tables.values() for c in t.columns]
    found = dict.fromkeys(by, (0, 0))
    for c, ps in by.items() if order not in ("nat", "inv") else ():
        values = db.tables[ps[0].table].select(name(ps[0].column)).distinct()
        ok = conjunction(ps, lambda p: name(p.column))
        r = values.agg(F.count_if(F.coalesce(ok, F.lit(False))).alias("m"), F.count(name(ps[0].column)).alias("d")).first()
        found[c] = (int(r.m), int(r.d) + 2)
    return ordered(found, order, natural)

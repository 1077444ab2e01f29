"""Statistics over foreign keys: counts, fanouts, subtree and away weights, join sizes, dictionaries and codes.

Weights are sums passed along the keys of a tree of tables, so the size of a join is known without the join: every step
is one aggregation by key, partial before its shuffle. Products are decimals of 38 digits, as longs could overflow.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codes
from .graph import FkDef, adjacency, breadth_first

Tables = Mapping[str, DataFrame]
BIG = "decimal(38,0)"


def name(x: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col(f"`{x}`")


def product(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: (a * b).cast(BIG), columns, F.lit(1).cast(BIG))


# ---- counts and fanouts ----------------------------------------------------------------------------------------------


def fk_value_counts(child: DataFrame, fk: str) -> DataFrame:
    """Rows for each value of a foreign key; null keys drop out."""
    return child.where(name(fk).isNotNull()).groupBy(name(fk).alias(fk)).agg(F.count(F.lit(1)).alias("n"))


def fanout_name(table: str, key: str, other: str, other_key: str, adjacent: bool = True) -> str:
    return f"{table}.__{'adj_' * adjacent}fanout__:{key}={other}.{other_key}"


def with_adjacent_fanouts(table: str, tables: Tables, edges: Iterable[FkDef]) -> DataFrame:
    """The table's rows with the number of matching rows, 1 at least, over each of its edges. Seen from the referring side it is 1."""
    df = tables[table]
    own = [name(c) for c in df.columns]
    for e in edges:
        if e.parent == table:
            counts = fk_value_counts(tables[e.child], e.fk).select(name(e.fk).alias("_key"), F.col("n").alias("_n"))
            df = df.join(counts, name(e.pk) == F.col("_key"), "left")
            own.append(F.coalesce("_n", F.lit(1)).cast("long").alias(fanout_name(table, e.pk, e.child, e.fk)))
            df = df.select(*[name(c) for c in df.columns if c not in ("_key", "_n")], own[-1])
            own[-1] = name(df.columns[-1])
        elif e.child == table:
            made = fanout_name(table, e.fk, e.parent, e.pk)
            df = df.withColumn(made, F.lit(1).cast("long"))
            own.append(name(made))
    return df.select(*own)


def away(tables: Tables, edges: Iterable[FkDef], via: FkDef, to: str) -> DataFrame:
    """For each key of ``via`` the rows of the outer join of all tables on the far side, as seen from table ``to``: (key, w)."""
    edges = list(edges)
    far = via.other(to)
    rows = with_away(tables, edges, far, [e for e, _ in adjacency(edges)[far] if e != via])
    key = name(via.column_of(far))
    return rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.sum("__weight__").cast(BIG).alias("w"))


def with_away(tables: Tables, edges: Iterable[FkDef], table: str, over: Iterable[FkDef]) -> DataFrame:
    """Rows of ``table`` with ``__fanout__`` columns over the edges in ``over``, 1 at least, and their product ``__weight__``."""
    edges = list(edges)
    df = tables[table]
    columns = list(df.columns)
    made: list[str] = []
    for e in over:
        found = away(tables, edges, e, table).select(F.col("key").alias("_key"), F.col("w").alias("_w"))
        fan = fanout_name(table, e.column_of(table), e.other(table), e.column_of(e.other(table)), adjacent=False)
        df = df.join(found, name(e.column_of(table)) == F.col("_key"), "left")
        df = df.select(*[name(c) for c in [*columns, *made]], F.coalesce("_w", F.lit(1)).cast(BIG).alias(fan))
        made.append(fan)
    return df.withColumn("__weight__", product(name(m) for m in made))


def subtree_weights(tables: Tables, edges: Iterable[FkDef], root: str, table: str) -> DataFrame:
    """Rows of ``table`` with the weight of the subtree below it, the tree hung up at ``root``."""
    edges = list(edges)
    up = next(e for t, e, _ in breadth_first(root, edges) if t == table)
    return with_away(tables, edges, table, [e for e, _ in adjacency(edges).get(table, ()) if e != up])


def reachable_size(tables: Tables, edges: Iterable[FkDef], root: str) -> DataFrame:
    """Rows of the outer join that hold a row of the root: what a sample from the root is drawn from. One row: size."""
    return subtree_weights(tables, edges, root, root).agg(F.coalesce(F.sum("__weight__"), F.lit(0)).cast("long").alias("size"))


def full_outer_size(tables: Tables, edges: Iterable[FkDef], root: str) -> DataFrame:
    """Rows of the full outer join of a tree of tables: weights of the root's rows, and of rows no row above matches."""
    edges = list(edges)
    parts = []
    for table, e, above in breadth_first(root, edges):
        rows = subtree_weights(tables, edges, root, table)
        if e is not None:
            keys = tables[above].select(name(e.column_of(above)).alias("_key"))
            rows = rows.join(keys, name(e.column_of(table)) == F.col("_key"), "left_anti")
        parts.append(rows.agg(F.sum("__weight__").alias("w")))
    whole = reduce(DataFrame.unionAll, parts)
    return whole.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("long").alias("size"))


def prefixed(table: str, df: DataFrame) -> DataFrame:
    """Columns as ``table.column`` and the existence marker."""
    return df.select(*[name(c).alias(c if c.startswith(f"{table}.__") else f"{table}.{c}") for c in df.columns], F.lit(True).alias(f"__in__:{table}"))


def full_outer_join(tables: Tables, edges: Iterable[FkDef], root: str) -> DataFrame:
    """The full outer join of a tree of tables, columns by ``table.column``; markers ``__in__:table`` tell padding from nulls."""
    edges = list(edges)
    order = breadth_first(root, edges)
    df = prefixed(root, tables[root])
    for table, e, above in order[1:]:
        more = prefixed(table, tables[table])
        df = df.join(more, name(f"{above}.{e.column_of(above)}") == name(f"{table}.{e.column_of(table)}"), "full_outer")
    markers = [f"__in__:{t}" for t, _, _ in order]
    return df.select(*[F.coalesce(name(c), F.lit(False)).alias(c) if c in markers else name(c) for c in df.columns])


def count_by_messages(tables: Tables, edges: Iterable[FkDef], root: str) -> DataFrame:
    """COUNT(*) of the inner join of a tree of (filtered) tables, without the join. One row: cnt."""
    edges = list(edges)
    near = adjacency(edges)

    def rows(table: str, via: FkDef | None) -> DataFrame:
        df = tables[table]
        keep = {via.column_of(table)} if via else set()
        weights: list[str] = []
        for e, far in near.get(table, ()):
            if e == via:
                continue
            below = rows(far, e)
            key = name(e.column_of(far))
            message = below.where(key.isNotNull()).groupBy(key.alias("_key")).agg(F.sum("_w").cast(BIG).alias(f"_w{len(weights)}"))
            df = df.join(message, name(e.column_of(table)) == F.col("_key"), "inner").drop("_key")
            weights.append(f"_w{len(weights)}")
        return df.select(*[name(c) for c in sorted(keep)], product(F.col(w) for w in weights).alias("_w"))

    return rows(root, None).agg(F.coalesce(F.sum("_w"), F.lit(0)).cast("long").alias("cnt"))


def drop_like(df: DataFrame, pattern: str) -> DataFrame:
    """Without the columns whose names hold a match of a regular expression."""
    return df.select(*[name(c) for c in df.columns if not re.search(pattern, c)])


def filled(df: DataFrame) -> DataFrame:
    """(col, n): non-null values of every column, in one pass; columns of codes must all have as many as there are rows."""
    counts = df.agg(*[F.count(name(c)).alias(f"n{k}") for k, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"n{k}").alias("n")) for k, c in enumerate(df.columns)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def conditional_weights(df: DataFrame, fk: str, weight: str) -> DataFrame:
    """Each row's share of its key's weight; rows with null keys drop out. Sums are joined back, so a hot key is no single window."""
    rows = df.where(name(fk).isNotNull())
    sums = rows.groupBy(name(fk).alias("_key")).agg(F.sum(name(weight).cast("double")).alias("_sum"))
    return rows.join(sums, name(fk) == F.col("_key")).select(*[name(c) for c in df.columns], (name(weight).cast("double") / F.col("_sum")).alias("share"))


# ---- dictionaries ----------------------------------------------------------------------------------------------------


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(name(column).isNotNull()).select(name(column).alias("value")).distinct()


def domain_size(df: DataFrame, column: str) -> DataFrame:
    """Distinct values and two more, for unknown and NULL."""
    return df.agg((F.count_distinct(name(column)) + 2).alias("domain"))


def dictionary(df: DataFrame, column: str, ranges: int = 64) -> DataFrame:
    """(value, code): values in ascending order from code 2 on.

    Values are sorted in ranges, and a range's first code is the number of values in the ranges before it; the driver
    sees one count a range.
    """
    spark = df.sparkSession
    ranged = distinct_values(df, column).repartitionByRange(ranges, "value").withColumn("_range", F.spark_partition_id())
    # Which rows a range gets depends on a sample of the data, the same for the same data; the counts come from the same plan.
    ranged = ranged.persist()
    counts = {r["_range"]: r.n for r in ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], codes.FIRST
    for k in sorted(counts):
        before.append((k, total))
        total += counts[k]
    base = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    order = Window.partitionBy("_range").orderBy("value")
    return ranged.join(base, "_range").select("value", (F.col("_before") + F.row_number().over(order) - 1).cast("long").alias("code"))


def encode(df: DataFrame, column: str, found: DataFrame, out: str = "code", drop_unknown: bool = False, drop_null: bool = False) -> DataFrame:
    """Adds the code of ``column``: NULL is 1, values outside the dictionary 1 as well, unless those rows are dropped."""
    d = found.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    rows = df.where(name(column).isNotNull()) if drop_null else df
    rows = rows.join(d, name(column) == F.col("_value"), "left")
    if drop_unknown:
        rows = rows.where(F.col("_code").isNotNull() | name(column).isNull())
    return rows.select(*[name(c) for c in df.columns], F.coalesce("_code", F.lit(codes.NULL)).cast("long").alias(out))


def decode(df: DataFrame, code: str, found: DataFrame, out: str = "value") -> DataFrame:
    """Adds the value of a code; null for NULL and unknown."""
    d = found.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(d, name(code) == F.col("_code"), "left").select(*[name(c) for c in df.columns], F.col("_value").alias(out))

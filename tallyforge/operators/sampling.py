"""Weighted samples of outer joins, drawn down the tree, one row a table for each sample.

Uniforms are hashes of (seed, place in the tree, sample), so a draw doesn't depend on partitioning, and a recomputed
task draws the same.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import FkDef, breadth_first
from .statistics import Tables, name, prefixed, subtree_weights

BUCKETS = 256
KEY_BUCKETS = 32  # parts of a key's rows: a key with a third of all rows is so many tasks' work


def uniform(seed: int, tag: str, *keys: str) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(tag), *keys), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def sample_size(size: int, least: int = 100_000, most: int = 500_000) -> int:
    return max(least, min(most, size))


def _pick(rows: DataFrame, key: Column, weight: Column, draws: DataFrame, at: str) -> DataFrame:
    """For each draw (sample, key, point) the row of its key whose span of the running weight holds the point.

    Rows and draws are sorted together along the running weight, and a draw takes the last row before it: no pair of a
    row and a draw is ever made. Draws without a row keep null columns.
    """
    packed = rows.select(key.alias("_key"), F.struct(*[name(c) for c in rows.columns]).alias("_row"), weight.cast("double").alias("_w"))
    order = F.xxhash64("_row")
    run = Window.partitionBy("_key").orderBy(order, "_row").rowsBetween(Window.unboundedPreceding, -1)
    spans = packed.select("_key", F.coalesce(F.sum("_w").over(run), F.lit(0.0)).alias("_at"), F.lit(0).alias("_kind"), "_row", F.lit(None).cast("long").alias("sample"))
    asked = draws.select(F.col("_key"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(packed.schema["_row"].dataType).alias("_row"), "sample")
    along = Window.partitionBy("_key").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = spans.unionByName(asked).withColumn("_row", F.last("_row", ignorenulls=True).over(along))
    return merged.where(F.col("_kind") == 1).select("sample", "_row")


def _pick_in_parts(rows: DataFrame, key: Column, draws: DataFrame) -> DataFrame:
    """``_pick`` in two steps, by the column __weight__: first a part of the key's rows, by the parts' sums, then a row of it."""
    part = F.pmod(F.xxhash64(*[name(c) for c in rows.columns]), F.lit(KEY_BUCKETS)).cast("int")
    sums = rows.groupBy(key.alias("_of"), part.alias("_part")).agg(F.sum(F.col("__weight__").cast("double")).alias("_w"))
    ahead = Window.partitionBy("_of").orderBy("_part")  # KEY_BUCKETS rows a key at most
    spans = sums.select("_of", "_part", (F.sum("_w").over(ahead) - F.col("_w")).alias("_lo"))
    spans = spans.select("_of", "_part", "_lo", F.lead("_lo").over(ahead).alias("_hi"))  # a part ends where the next begins, to the bit
    into = draws.join(spans, (F.col("_key") == F.col("_of")) & (F.col("_in") >= F.col("_lo")) & (F.col("_hi").isNull() | (F.col("_in") < F.col("_hi"))))
    asked = into.select("sample", F.struct(F.col("_of").alias("k"), F.col("_part").alias("b")).alias("_key"), (F.col("_in") - F.col("_lo")).alias("_in"))
    return _pick(rows, F.struct(key.alias("k"), part.alias("b")), F.col("__weight__"), asked, "_in")


def sample_rows(rows: DataFrame, weight: str, n: int, seed: int, tag: str) -> DataFrame:
    """n rows drawn with replacement in proportion to ``weight``; adds sample, 0 to n - 1. Weights of 0 are never drawn."""
    spark = rows.sparkSession
    bucketed = rows.where(name(weight) > 0).withColumn("_bucket", F.pmod(F.xxhash64(*[name(c) for c in rows.columns]), F.lit(BUCKETS)).cast("int"))
    sums = sorted((r["_bucket"], float(r.w)) for r in bucketed.groupBy("_bucket").agg(F.sum(name(weight).cast("double")).alias("w")).collect())
    total = sum(w for _, w in sums)
    if not total:
        return rows.limit(0).withColumn("sample", F.lit(0).cast("long"))
    edges, at = [], 0.0
    for b, w in sums:
        edges.append((b, at, at + w))
        at += w
    spans = F.broadcast(spark.createDataFrame(edges, "_key int, _lo double, _hi double"))  # one row a bucket
    draws = spark.range(n).select(F.col("id").alias("sample"), (uniform(seed, tag, "id") * F.lit(total)).alias("_point"))
    draws = draws.join(spans, (F.col("_point") >= F.col("_lo")) & (F.col("_point") < F.col("_hi"))).withColumn("_in", F.col("_point") - F.col("_lo"))
    return _pick(bucketed.drop("_bucket"), F.pmod(F.xxhash64(*[name(c) for c in rows.columns]), F.lit(BUCKETS)).cast("int"), name(weight), draws, "_in").select("sample", "_row.*")


def sample_join(tables: Tables, edges: Iterable[FkDef], root: str, n: int, seed: int = 1234) -> DataFrame:
    """n rows of the outer join reachable from ``root``, with replacement, each equally likely.

    Columns ``table.column``, ``__in__:table`` and the root's and inner tables' ``table.__fanout__...``; sample numbers
    the rows. A row without a match has nulls, fanouts of 1 and a false marker.
    """
    edges = list(edges)
    order = breadth_first(root, edges)
    weighted = {t: subtree_weights(tables, edges, root, t) for t, _, _ in order}

    def ready(table: str) -> DataFrame:
        df = weighted[table]
        return prefixed(table, df.select(*[name(c) for c in df.columns if c != "__weight__"]))

    def columns(df: DataFrame, table: str) -> list[Column]:
        """Of a joined frame: fanouts and the marker filled in where the table has no row."""
        out = []
        for c in ready(table).columns:
            if c == f"__in__:{table}":
                out.append(F.coalesce(name(c), F.lit(False)).alias(c))
            elif "_fanout__" in c:
                out.append(F.coalesce(name(c).cast("long"), F.lit(1).cast("long")).alias(c))
            else:
                out.append(name(c))
        return out

    first = sample_rows(weighted[root], "__weight__", n, seed, root)
    held = first.select("sample", *[name(c).alias(c if c.startswith(f"{root}.__") else f"{root}.{c}") for c in first.columns if c not in ("sample", "__weight__")], F.lit(True).alias(f"__in__:{root}"))
    held = held.select("sample", *columns(held, root))
    for table, e, above in order[1:]:
        key = name(f"{above}.{e.column_of(above)}")
        if e.parent == table:  # many to one: the one row, if any
            right = ready(table)
            held = held.join(right, key == name(f"{table}.{e.pk}"), "left")
        else:
            rows = weighted[table].where(name(e.fk).isNotNull())
            sums = rows.groupBy(name(e.fk).alias("_key")).agg(F.sum(F.col("__weight__").cast("double")).alias("_sum"))
            draws = held.select("sample", key.alias("_key")).join(sums, "_key").withColumn("_in", uniform(seed, table, "sample") * F.col("_sum"))
            # Only keys that were drawn take part.
            drawn = rows.join(draws.select(F.col("_key").alias("_drawn")).distinct(), name(e.fk) == F.col("_drawn"), "left_semi")
            picked = _pick_in_parts(drawn, name(e.fk), draws).select("sample", "_row.*")
            picked = picked.select(F.col("sample").alias("_sample"), *[name(c).alias(c if c.startswith(f"{table}.__") else f"{table}.{c}") for c in picked.columns if c not in ("sample", "__weight__")], F.lit(True).alias(f"__in__:{table}"))
            held = held.join(picked, F.col("sample") == F.col("_sample"), "left").drop("_sample")
        mine = set(ready(table).columns)
        held = held.select(*[name(c) for c in held.columns if c not in mine], *columns(held, table))
    return held

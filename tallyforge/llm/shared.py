"""What the operators share: the folder all executors see, staged tables, and connected components."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shipping
from ..sources.scratch import new_path

ROWS_A_BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, and cut the session's batches for Python to ROWS_A_BATCH rows, as rows hold whole
    texts; a smaller setting stays. The setting holds for the session's other queries as well."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ROWS_A_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    shipping.ship(spark)


def stage(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop(*staged: DataFrame) -> None:
    """Delete tables made by ``stage`` that nothing will read again."""
    for df in staged:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that no column of ``taken`` has, whatever the case of its letters."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


#: Words of a sieve, of 64 bits each: it is broadcast, and has no more rows than this whatever it is made from.
SIEVE_WORDS = 1 << 20


def sifted(rows: DataFrame, wanted: DataFrame, key: str, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: false only where no row of ``wanted`` has the same value in ``key`` (a hash, a long, not null).

    A bitmap of a fixed number of bits is broadcast; the more is wanted, the more of the others it lets through.
    """
    def bit(what: str, a: Column, slot: Column) -> Column:
        return F.call_function(what, a, slot.bitwiseAND(F.lit(63)).cast("int"))

    slot = F.pmod(F.col(key), F.lit(64 * SIEVE_WORDS))
    word, bits = (fresh(rows.columns, c) for c in ("word", "bits"))
    held = wanted.groupBy(F.shiftrightunsigned(slot, 6).alias(word)).agg(F.bit_or(bit("shiftleft", F.lit(1).cast("long"), slot)).alias(bits))
    named = rows.withColumn(word, F.shiftrightunsigned(slot, 6)).join(F.broadcast(held), word, "left")
    return named.withColumn(flag, F.coalesce(bit("shiftright", F.col(bits), slot).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))).drop(word, bits)


def spread_join(
    left: DataFrame, right: DataFrame, key: str, how: str = "inner", same: Column | None = None, hot: DataFrame | None = None, counted: DataFrame | None = None, ways: int = 32, many: list | None = None
) -> DataFrame:
    """Join on ``key`` (and ``same``) in which a key with more than a thousandth of the left rows is dealt to ``ways`` tasks.

    Right rows of such keys are copied, so there should be few a key. At most a thousand keys are hot, whatever the size.
    A left join deals null keys out as well. hot: (key, number of rows) where these are known; counted: rows to count
    instead of ``left``; many: the hot keys themselves, from ``hot_keys``. Columns other than the key must differ in name;
    the right key is dropped.
    """
    if many is None:
        counts = hot.toDF(key, "m") if hot is not None else (counted if counted is not None else left).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("m"))
        many = hot_keys(counts, key)
    salt = fresh([*left.columns, *right.columns], "salt")
    other = fresh([*left.columns, *right.columns, salt], "to")
    right = right.withColumnRenamed(key, other)
    on = F.col(key) == F.col(other)
    if not many and how == "inner":
        return left.join(right, on if same is None else on & same, how).drop(other)
    dealt_out = F.col(key).isin(many) if many else F.lit(False)
    copied_to = F.col(other).isin(many) if many else F.lit(False)
    dealt = left.withColumn(salt, F.when(dealt_out | F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(ways)).cast("int")).otherwise(0))
    copied = right.withColumn(f"{other}_{salt}", F.explode(F.when(copied_to, F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0)))))
    on = on & (F.col(salt) == F.col(f"{other}_{salt}"))
    return dealt.join(copied, on if same is None else on & same, how).drop(salt, other, f"{other}_{salt}")


def hot_keys(counts: DataFrame, key: str, total: int | None = None) -> list:
    """Keys of (key, m) with more than 1,000 rows and a thousandth of all (``total`` where it is known); a thousand at most."""
    many = counts.where(F.col("m") > 1000).orderBy(F.desc("m")).limit(1000).select(key, "m").collect()
    if not many:
        return []
    total = counts.agg(F.sum("m")).first()[0] if total is None else total
    return [r[0] for r in many if r.m > total / 1000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected graph in ``edges`` (columns a, b of one orderable type).

    Returns (node, component) for every node of an edge; component is the smallest node reachable. Loops and repeated
    edges are allowed, rows with a null end are ignored, and no edges give no rows.

    Every round each node picks, among itself and its neighbours, the one whose hash in this round is least, and the
    graph is contracted along the picks. The expected number of rounds is logarithmic, whatever the shape (a path under
    plain smallest-label propagation takes as many rounds as it has nodes). Hubs cost nothing special: picks are
    aggregated before the shuffle, and only the side of the edges can be skewed in the joins, which AQE splits.
    """
    e = stage(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    picks: list[DataFrame] = []
    used = [e]
    while not e.isEmpty():
        def rank(c: str, turn: int = len(picks)) -> Column:
            return F.xxhash64(F.lit(turn), F.col(c))

        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        pick = stage(
            both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("to"))).alias("m"))
            .select(F.col("a").alias("node"), F.when(rank("a") <= F.col("m.h"), F.col("a")).otherwise(F.col("m.to")).alias("to")),
            "pick",
        )
        picks.append(pick)
        at_a = pick.select(F.col("node").alias("a"), F.col("to").alias("x"))
        at_b = pick.select(F.col("node").alias("b"), F.col("to").alias("y"))
        e = stage(
            e.join(at_a, "a").join(at_b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
            "edges",
        )
        used.append(e)
    if not picks:
        drop(*used)
        loops = edges.where("a is not null and a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        return stage(loops, "components")
    root = picks[-1].select("node", "to")
    for pick in picks[-2::-1]:  # from the smallest graph back to the whole one; sizes fall geometrically
        later = root.select(F.col("node").alias("to"), F.col("to").alias("end"))
        root = pick.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    root = stage(root, "root")
    least = root.groupBy("to").agg(F.min("node").alias("component"))
    out = stage(root.join(least, "to").select("node", "component"), "components")
    drop(*used, *picks, root)
    return out

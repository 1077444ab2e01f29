"""Accuracy measures and small helpers over result columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.5, 0.9, 0.95, 0.99, 1.0)


def q_error(estimate: Column, truth: Column) -> Column:
    """Larger ratio of the two; where one is 0 the other, where both are, 1."""
    e, t = estimate.cast("double"), truth.cast("double")
    return F.when((e == 0) & (t == 0), 1.0).when(e == 0, t).when(t == 0, e).otherwise(F.greatest(e / t, t / e))


def nearest_quantiles(df: DataFrame, column: str, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """quantile, value: the element of the sorted column nearest to q (n - 1), halves to even.

    Ranks are counted by distributed sort: a task's share of the rows, then the shares' sizes.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    total = F.count(F.lit(1))
    asked = df.sparkSession.createDataFrame([(q,) for q in quantiles], "quantile double")
    counts = rows.groupBy("value").agg(total.alias("n"))
    from pyspark.sql import Window

    # Distinct values of an error column; their running count gives the ranks each covers.
    part = counts.withColumn("bin", F.floor(F.log2(F.greatest(F.col("value"), F.lit(1e-300))) * 8))
    bins = part.groupBy("bin").agg(F.sum("n").alias("m"))  # a few thousand at most for doubles
    ahead = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("bin", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    spans = part.join(F.broadcast(bins), "bin").select("value", "n", (F.col("before") + F.sum("n").over(inside)).alias("end"))
    size = rows.agg(total.alias("size"))
    at = asked.crossJoin(size).select("quantile", F.bround(F.col("quantile") * (F.col("size") - 1)).cast("long").alias("rank"))
    return spans.join(F.broadcast(at), (F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n"))).select("quantile", "value")


def report(df: DataFrame, error: str, elapsed: str | None = None) -> DataFrame:
    """max, linear quantiles (99, 95, 90, 50) and mean of an error column, and the mean time where there is one."""
    cols = [F.max(error).alias("max_err"), *(F.percentile(error, F.lit(q)).alias(f"p{int(q * 100)}_err") for q in (0.99, 0.95, 0.9, 0.5)), F.avg(error).alias("mean_err")]
    return df.agg(*cols, *([F.avg(elapsed).alias("mean_ms")] if elapsed else []))


def spread(df: DataFrame, column: str) -> DataFrame:
    """min, median and max of a column, for summaries."""
    return df.agg(F.min(column).alias("min"), F.percentile(column, F.lit(0.5)).alias("median"), F.max(column).alias("max"))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """One row: mean of ``value`` weighted by ``weight`` (a loss by the rows of its batch); null without rows."""
    return df.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"))


def entropy(df: DataFrame, column: str, base: float = 2.0) -> DataFrame:
    """Shannon entropy of a column's values, nulls included as one value."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h")).select((F.col("h") / F.log(F.lit(base))).alias("entropy"))


def join_order_json(order: Column, skip: int = 7) -> Column:
    """A join order such as ``Leading(t (mc cn))`` as a JSON array: the first characters go, the rest becomes brackets, commas and strings."""
    bare = F.replace(F.replace(F.replace(F.substr(order, F.lit(skip + 1)), F.lit("("), F.lit("[")), F.lit(")"), F.lit("]")), F.lit(" "), F.lit(","))
    return F.regexp_replace(bare, r"([\w_]+)", '"$1"')

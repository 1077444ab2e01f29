"""Foreign-key counts kept up to date over a stream of child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.statistics import name


def fk_counts(stream: DataFrame, fk: str) -> DataFrame:
    """Running rows for each value of a foreign key, for output mode update or complete. Null keys drop out."""
    return stream.where(name(fk).isNotNull()).groupBy(name(fk).alias(fk)).agg(F.count(F.lit(1)).alias("n"))


def keep_fk_counts(stream: DataFrame, fk: str, view: str, checkpoint: str) -> StreamingQuery:
    """Start a query that holds the counts in the in-memory table ``view``."""
    return (
        fk_counts(stream, fk).writeStream.outputMode("complete").format("memory").queryName(view)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )

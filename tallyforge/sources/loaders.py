"""Reading base tables, benchmark files and stored stages; writing results."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import Schema, TableDef
from ..operators.statistics import name


def clean(df: DataFrame, table: TableDef) -> DataFrame:
    """The declared columns, zone-less times, and the declared casts; text that can't be cast becomes null.

    A cast for a column that is not there is ignored with the column.
    """
    there = {c.lower(): c for c in df.columns}
    casts = dict(table.casts)
    out = []
    for c in table.columns:
        if c.lower() not in there:
            raise ValueError(f"{table.name} has no column {c}")
        col = name(there[c.lower()])
        kind = df.schema[there[c.lower()]].dataType
        if c in casts:
            col = col.try_cast(casts[c])
        elif isinstance(kind, T.TimestampType):
            col = col.cast("timestamp_ntz")
        out.append(col.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True) -> DataFrame:
    """CSV with a backslash as escape; give a schema, or the file is read twice to guess one."""
    reader = spark.read.option("header", header).option("escape", "\\").option("multiLine", False)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_table(spark: SparkSession, path: str, table: TableDef, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, ORC, JSON or CSV by the path's ending; only declared columns reach the scan."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("parquet", "orc", "json"):
        df = getattr(spark.read, kind)(path)
    else:
        df = read_csv(spark, path, schema)
    return clean(df, table)


def read_jdbc(spark: SparkSession, url: str, table: str, weight: str | None = None, **options: str) -> DataFrame:
    """A database table; a weight column is scaled to sum 1."""
    df = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    if weight:
        total = df.agg(F.sum(name(weight)).alias("_total"))
        df = df.crossJoin(F.broadcast(total)).withColumn(weight, name(weight) / F.col("_total")).drop("_total")  # one row
    return df


KINDS = ("parquet", "orc", "json", "csv")


def there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_tables(spark: SparkSession, folder: str, schema: Schema) -> dict[str, DataFrame]:
    """All tables of a schema, from ``folder/table.parquet``, ``.orc``, ``.json`` or ``.csv``, the first that is there."""
    if len(schema.tables) == 1 and "." in os.path.basename(folder.rstrip("/")):
        (table,) = schema.tables.values()
        return {table.name: read_table(spark, folder, table)}
    return {t.name: read_table(spark, next((p for p in (f"{folder}/{t.name}.{kind}" for kind in KINDS) if there(spark, p)), f"{folder}/{t.name}.parquet"), t) for t in schema.tables.values()}


BENCHMARK = "true_cardinality long, sql string"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """true_cardinality, sql, and name, node where the file has them."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return df.withColumn("true_cardinality", F.col("true_cardinality").cast("long"))


def read_subqueries(spark: SparkSession, path: str) -> DataFrame:
    """name, node, true_cardinality, sql of sub-queries, from a CSV or a JSON file; node: the tables, joined by commas."""
    df = spark.read.json(path) if path.rstrip("/").endswith(".json") else read_benchmark(spark, path)
    missing = {"name", "node", "true_cardinality", "sql"} - set(df.columns)
    if missing:
        raise ValueError(f"{path} has no {', '.join(sorted(missing))}")
    return df.select(F.col("name").cast("string"), "node", F.col("true_cardinality").cast("long"), "sql")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p.suffix("/_SUCCESS")) or p.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(p)


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage that is computed once: written at ``path`` unless it is there, then read."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_results(df: DataFrame, path: str, columns: Iterable[str] | None = None) -> None:
    (df.select(*columns) if columns else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

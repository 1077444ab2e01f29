"""More queries over the test tables: sources, stages, predicate masks, plans, schemas and evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, measures
from ..functions.predicates import Predicate, conjunction, merged, normalize, split_by_tables
from ..models import density
from ..operators import sampling, statistics
from ..operators.graph import Schema, TableDef, breadth_first
from ..operators.statistics import name
from ..shipping import ship
from ..sources import embedded, loaders
from ..sources.schemas import SCHEMAS, testdata
from ..sources.scratch import new_path
from ..sources.stages import Stages
from . import estimators, evaluation
from .catalog import _CHAIN, ESTIMATED, SPJ, _chain, database, query
from .database import Database

# ---- sources -----------------------------------------------------------------------------------------------------------


@query("scan_csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A CSV file read with a given schema, its declared columns alone, casts from text included."""
    path = new_path(spark, "part") + ".csv"
    loaders.read_tables(spark, d, testdata())["part"].write.option("header", True).option("escape", "\\").csv(path)
    t = TableDef("part", ("p_partkey", "p_name", "p_size", "p_retailprice"), "p_partkey", (("p_size", "int"), ("no_such_column", "int")))
    return loaders.read_table(spark, path, t, "p_partkey long, p_name string, p_brand string, p_type string, p_size string, p_retailprice double")


@query("scan_csv_casts", "SELECT CAST(1 AS BIGINT) AS id, TIMESTAMP '2020-01-02 03:04:05' AS at, CAST(7 AS INT) AS n UNION ALL SELECT 2, NULL, NULL UNION ALL SELECT 3, TIMESTAMP '1999-12-31 00:00:00', -1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Text to times and numbers; what can't be cast becomes null."""
    path = new_path(spark, "casts") + ".csv"
    spark.createDataFrame([(1, "2020-01-02 03:04:05", "7"), (2, "soon", "x"), (3, "1999-12-31", "-1")], "id long, at string, n string").coalesce(1).write.option("header", True).csv(path)
    return loaders.read_table(spark, path, TableDef("casts", ("id", "at", "n"), None, (("at", "timestamp_ntz"), ("n", "int"))), "id long, at string, n string")


@query("scan_jdbc", "SELECT n_nationkey, n_name, ROUND(n_regionkey / SUM(n_regionkey) OVER (), 9) AS share FROM nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A database table through JDBC (the embedded database that Spark brings along), a weight column scaled to sum 1."""
    nations = loaders.read_tables(spark, d, testdata())["nation"].select(name("n_nationkey").alias("K"), name("n_name").alias("NAME"), name("n_regionkey").cast("double").alias("W"))
    found = loaders.read_jdbc(spark, table="NATIONS", weight="W", **embedded.write_jdbc(spark, nations, "NATIONS"))
    return found.select(name("K").alias("n_nationkey"), name("NAME").alias("n_name"), F.round("W", 9).alias("share"))


@query("load_any_format", "SELECT COUNT(*) AS cnt FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey WHERE r_name <> 'ASIA'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A folder of tables as CSV, ORC and JSON, assembled into a database."""
    s = Schema("places").add_table("region", ["r_regionkey", "r_name"], casts={"r_regionkey": "int"}).add_table("nation", ["n_nationkey", "n_regionkey"]).add_table("customer", ["c_custkey", "c_nationkey"], casts={"c_nationkey": "int"})
    s.add_relationship("region", "r_regionkey", "nation", "n_regionkey").add_relationship("nation", "n_nationkey", "customer", "c_nationkey")
    t, path = loaders.read_tables(spark, d, testdata()), new_path(spark, "formats")
    t["region"].write.option("header", True).csv(f"{path}/region.csv")
    t["nation"].write.orc(f"{path}/nation.orc")
    t["customer"].write.json(f"{path}/customer.json")
    return Database(spark, s, loaders.read_tables(spark, path, s)).count("SELECT COUNT(*) FROM region r, nation n, customer c WHERE r.r_regionkey = n.n_regionkey AND n.n_nationkey = c.c_nationkey AND r.r_name <> 'ASIA'")


@query("from_dataframe", "SELECT COUNT(*) AS cnt FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A table that is a DataFrame of the caller's."""
    t = loaders.read_tables(spark, d, testdata())
    own = spark.createDataFrame(t["nation"].collect(), t["nation"].schema)  # 25 rows
    return Database(spark, testdata(), t | {"nation": own}).count("SELECT COUNT(*) FROM nation n, customer c WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1")


@query("dataset_registry", """SELECT * FROM (VALUES ('testdata', 7, 7, 37), ('imdb', 16, 15, 51), ('imdb-job-light', 6, 5, 14), ('dmv', 1, 0, 11), ('dmv-tiny', 1, 0, 11),
('dmv-1', 1, 0, 10), ('dmv-2', 1, 0, 9), ('dmv-5', 1, 0, 6), ('flight-delays', 1, 0, 12), ('flight-delays-tiny', 1, 0, 12)) t(dataset, tables, keys, columns)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    made = {k: f() for k, f in SCHEMAS.items()}
    rows = [(k, len(s.tables), len(s.fks), sum(len(t.columns) for t in s.tables.values())) for k, s in made.items()]
    return spark.createDataFrame(rows, "dataset string, tables int, keys int, columns int")


_BENCHMARK = " UNION ALL ".join(f"SELECT {k} AS query_no, COUNT(*) AS c {q.split('COUNT(*)', 1)[1]}" for k, q in enumerate(ESTIMATED.values()))


def _truths(k: int) -> int:
    return (0, 700, 1000, 40)[k]


def _benchmark_file(spark: SparkSession) -> str:
    path = new_path(spark, "benchmark") + ".csv"
    rows = [(_truths(k), q + " ") for k, q in enumerate(ESTIMATED.values())]
    spark.createDataFrame(rows, "true_cardinality long, sql string").coalesce(1).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("benchmark_run", f"""SELECT query_no::INT AS query_no, c AS estimated_cardinality, t AS true_cardinality,
ROUND(CASE WHEN c = 0 AND t = 0 THEN 1 WHEN c = 0 THEN t WHEN t = 0 THEN c ELSE GREATEST(c::DOUBLE / t, t::DOUBLE / c) END, 6) AS q_err
FROM (SELECT query_no, c, [0, 700, 1000, 40][query_no + 1]::BIGINT AS t FROM ({_BENCHMARK}))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark file, run query by query, and its results written and read again."""
    db = database(spark, d)
    asked = sorted((r.true_cardinality, r.sql) for r in loaders.read_benchmark(spark, _benchmark_file(spark)).collect())
    by = {q: k for k, q in enumerate(ESTIMATED.values())}
    asked.sort(key=lambda x: by[x[1].strip()])
    results = evaluation.evaluate(db, "exact", db.count, asked)
    path = new_path(spark, "results") + ".csv"
    loaders.write_results(results, path, ["query_no", "q_err", "estimated_cardinality", "true_cardinality", "elapsed_time_ms"])
    back = loaders.read_csv(spark, path, "query_no int, q_err double, estimated_cardinality long, true_cardinality long, elapsed_time_ms double").where("elapsed_time_ms > 0")
    return back.select("query_no", "estimated_cardinality", "true_cardinality", F.round("q_err", 6).alias("q_err"))


@query("estimator_stats", "SELECT CAST(3 AS BIGINT) AS n, MAX(e) AS max_err, ROUND(AVG(e), 6) AS mean_err, TRUE AS timed FROM (SELECT UNNEST([c / 2.0, c / 4.0, 8.0 / 2])::DOUBLE AS e FROM (SELECT COUNT(*) AS c FROM nation))")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Errors and times of two runs of an estimator, put together."""
    db = database(spark, d)
    first, second = (evaluation.Estimator(x, db.count) for x in ("first", "second"))
    first.query("SELECT COUNT(*) FROM nation n", 2)
    second.query("SELECT COUNT(*) FROM nation n", 4)
    second.merge_stats([("third", 0, 2, 8, 1.0)])
    whole = first.merge_stats(second.get_stats())
    report = whole.report(spark)
    return report.select(F.lit(len(whole.rows)).cast("long").alias("n"), "max_err", F.round("mean_err", 6).alias("mean_err"), (F.col("mean_ms") > 0).alias("timed"))


@query("value_spread", "SELECT MIN(l_quantity) AS min, MEDIAN(l_quantity) AS median, MAX(l_quantity) AS max FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return measures.spread(database(spark, d).tables["lineitem"], "l_quantity")


@query("weighted_loss", "SELECT ROUND(SUM(l_discount * l_quantity) / SUM(l_quantity), 9) AS mean FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    return measures.weighted_mean(database(spark, d).tables["lineitem"], "l_discount", "l_quantity").select(F.round("mean", 9).alias("mean"))


# ---- stages --------------------------------------------------------------------------------------------------------------


def _stages(spark: SparkSession, d: str) -> Stages:
    db = database(spark, d)
    return Stages(db.schema, db.tables, new_path(spark, "stages"), d)


@query("stage_fk_counts", "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _stages(spark, d)
    s.fk_counts("lineitem", "l_partkey")
    s.tables = {}  # the second time nothing is computed
    return s.fk_counts("lineitem", "l_partkey")


_FANOUTS = "SELECT o_orderkey, COALESCE(n, 1) AS lines, CAST(1 AS BIGINT) AS customers FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"
_LINES, _CUSTOMERS = "orders.__adj_fanout__:o_orderkey=lineitem.l_orderkey", "orders.__adj_fanout__:o_custkey=customer.c_custkey"


@query("stage_fanouts", _FANOUTS)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d).fanouts("orders").select("o_orderkey", name(_LINES).alias("lines"), name(_CUSTOMERS).alias("customers"))


@query("stage_base_with_fanouts", f"SELECT o.*, lines, customers FROM orders o JOIN ({_FANOUTS}) USING (o_orderkey)")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = _stages(spark, d).base_with_fanouts("orders")
    assert found.columns == sorted(found.columns)
    return found.withColumnsRenamed({_LINES: "lines", _CUSTOMERS: "customers"})


@query("stage_dictionary", "SELECT value, DENSE_RANK() OVER (ORDER BY value) + 1 AS code FROM (SELECT DISTINCT p_type AS value FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _stages(spark, d)
    s.dictionary("part", "p_type")
    return s.dictionary("part", "p_type").select("value", "code")


@query("dictionaries_of_tables", "SELECT 'region.r_name' AS col, COUNT(DISTINCT r_name) AS n, MAX(r_name) AS last FROM region UNION ALL SELECT 'region.r_regionkey', COUNT(DISTINCT r_regionkey), MAX(r_regionkey)::VARCHAR FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All dictionaries of a database, stored and loaded by name."""
    small = Schema("small").add_table("region", ["r_regionkey", "r_name"])
    s = Stages(small, {"region": database(spark, d).tables["region"]}, new_path(spark, "stages"))
    s.dictionaries()
    parts = [v.agg(F.lit(c).alias("col"), F.count(F.lit(1)).alias("n"), F.max(F.col("value").cast("string")).alias("last")).select("col", "n", "last") for c, v in s.dictionaries().items()]
    return parts[0].unionAll(parts[1])


@query("stage_joined", "SELECT CAST(3000 AS BIGINT) AS n, CAST(3000 AS BIGINT) AS samples, TRUE AS keys_match FROM region LIMIT 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _stages(spark, d)
    sub = next(x for x in s.schema.neighbourhoods() if x.center == "orders")
    s.sample(sub, 3000, 7)
    found = s.sample(sub, 3000, 7)
    return found.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample").alias("samples"), F.every(name("orders.o_custkey") == name("customer.c_custkey")).alias("keys_match"))


@query("stage_discretized", "SELECT o_orderkey, DENSE_RANK() OVER (ORDER BY o_orderpriority) + 1 AS code FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = _stages(spark, d)
    sub = next(x for x in s.schema.neighbourhoods() if x.center == "orders")

    def make() -> DataFrame:
        return statistics.encode(s.tables["orders"], "o_orderpriority", s.dictionary("orders", "o_orderpriority")).select("o_orderkey", "code")

    s.discretized(sub, make, threshold=16)
    return s.discretized(sub, make, threshold=16)


@query("filled_columns", "SELECT * FROM (SELECT 'o_orderkey' AS col, COUNT(*) AS n FROM orders UNION ALL SELECT 'status', COUNT(NULLIF(o_orderstatus, 'O')) FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["orders"]
    return statistics.filled(t.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("status")))


@query("drop_columns_like", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    return statistics.drop_like(statistics.subtree_weights(db.tables, _CHAIN, "customer", "orders"), r"__weight__|_fanout__|^o_order(st|d|p)|^o_tot")


# ---- predicates ----------------------------------------------------------------------------------------------------------


@query("pred_all_true_false", "SELECT COUNT(*) AS all_true, CAST(0 AS BIGINT) AS all_false FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["orders"]
    made = [conjunction([Predicate("orders", "o_orderstatus", op)], lambda p: F.col(p.column)) for op in ("ALL_TRUE", "ALL_FALSE")]
    return t.agg(F.count_if(made[0]).alias("all_true"), F.count_if(made[1]).alias("all_false"))


_SETS = [Predicate("part", "p_size", "IN", (1, 5, 9, 20, 33)), Predicate("part", "p_size", "IN", (5, 9, 20, 40)), Predicate("part", "p_size", "NOT IN", (9, 2)), Predicate("part", "p_size", "BETWEEN", (3, 30))]


@query("pred_merged_sets", "SELECT COUNT(*) AS cnt, 3 AS predicates FROM part WHERE p_size IN (1, 5, 9, 20, 33) AND p_size IN (5, 9, 20, 40) AND p_size NOT IN (9, 2) AND p_size BETWEEN 3 AND 30")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = normalize(_SETS)
    assert [p.value for p in merged(_SETS[:3])] == [(5, 20)]
    return database(spark, d).filtered("part", tuple(found)).agg(F.count(F.lit(1)).alias("cnt"), F.lit(len(found)).alias("predicates"))


@query("pred_routing", "SELECT * FROM (VALUES ('part.p_size', TRUE), ('part.p_type', TRUE), ('part.p_brand', TRUE), ('lineitem.l_returnflag', FALSE)) t(col, inside)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from .catalog import _PREDICATES

    parts = split_by_tables(_PREDICATES, ["part", "orders"])
    return spark.createDataFrame([(p.name, not k) for k, ps in enumerate(parts) for p in ps], "col string, inside boolean")


_MASKED = {
    "range": ([Predicate("lineitem", "l_extendedprice", ">=", 20000), Predicate("lineitem", "l_extendedprice", "<", 50000.5)], "l_extendedprice >= 20000 AND l_extendedprice < 50000.5"),
    "not": ([Predicate("lineitem", "l_extendedprice", "!=", 20000)], "l_extendedprice <> 20000"),
    "in": ([Predicate("lineitem", "l_extendedprice", "IN", (1.5, 901.0, 20000.0))], "l_extendedprice IN (1.5, 901.0, 20000.0)"),
    "unknown": ([Predicate("lineitem", "l_extendedprice", "=", -5.0)], "l_extendedprice = -5.0"),
    "beyond": ([Predicate("lineitem", "l_extendedprice", "<=", 1e12)], "l_extendedprice <= 1e12"),
}


@query("pred_slice_masks", " UNION ALL ".join(f"SELECT '{k}' AS kind, COUNT(*) FILTER ({w}) AS n FROM lineitem" for k, (_, w) in _MASKED.items()))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Predicates as masks over the bit slices of codes, high bits first: rows that pass every slice's mask."""
    from . import learned

    t = database(spark, d).tables["lineitem"].select("l_extendedprice")
    found = statistics.dictionary(t, "l_extendedprice")
    size = found.count() + codes.FIRST
    slices = codes.factorize(size, 5)
    enc = learned.Encoded(["price"], {"price": found}, {"price": slices}, {"price": size}, {}, {}, {("price", s.index): s.index for s in slices}, [s.size for s in slices])
    masks = {k: learned.bit_masks(enc, "price", learned.matching_codes(found, ps)) for k, (ps, _) in _MASKED.items()}
    rows = statistics.encode(t, "l_extendedprice", found).select(*[codes.slice_code(F.col("code"), s).cast("int").alias(f"s{s.index}") for s in slices])
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([c.to_numpy() for c in b.columns], 1) if b.num_rows else np.zeros((0, len(slices)), np.int64)
            for k, steps in masks.items():
                ok = np.ones(len(x), bool)
                for column, mask in steps:
                    allowed = mask(x) if callable(mask) else np.broadcast_to(mask, (len(x), len(mask)))
                    ok &= allowed[np.arange(len(x)), x[:, column]] > 0
                yield pa.record_batch({"kind": pa.array([k]), "m": pa.array([int(ok.sum())], pa.int64())})

    return rows.mapInArrow(run, "kind string, m long").groupBy("kind").agg(F.sum("m").alias("n"))


@query("exp2_of_log", "SELECT o_orderkey, CAST(COALESCE(n, 1) AS DOUBLE) AS back FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.subtree_weights(database(spark, d).tables, _CHAIN, "customer", "orders")
    return df.select("o_orderkey", F.round(codes.from_log_fanout(codes.log_fanout(F.col("__weight__"))), 4).alias("back"))


# ---- joins, plans, schemas -----------------------------------------------------------------------------------------------


@query("spj_lower_case", "SELECT COUNT(*) AS cnt FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Names in any case, where the schema's are lower."""
    s = Schema("lower", lower=True).add_table("ORDERS", ["O_OrderKey", "O_OrderStatus"])
    return Database(spark, s, {"orders": database(spark, d).tables["orders"]}).count("SELECT COUNT(*) FROM Orders O WHERE O.O_ORDERSTATUS = 'F'")


@query("parallel_keys", """SELECT * FROM (VALUES ('flights:from_id=place.id', 2), ('flights:to_id=place.id', 2)) t(name, tables)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two keys between the same tables: one partition for each choice."""
    s = Schema("air").add_table("place", ["id"]).add_table("flights", ["from_id", "to_id"])
    s.add_relationship("place", "id", "flights", "from_id").add_relationship("place", "id", "flights", "to_id")
    return spark.createDataFrame([(x.name, len(x.tables)) for x in s.neighbourhoods()], "name string, tables int")


@query("schema_paths", """SELECT * FROM (VALUES (1, 'customer>orders>lineitem>part'), (2, 'customer>nation>supplier>lineitem>part')) t(place, path)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k + 1, ">".join(p)) for k, p in enumerate(testdata().paths("customer", "part"))], "place int, path string")


@query("schema_hypergraph", """SELECT * FROM (VALUES ('customer', 'customer,nation'), ('lineitem', 'lineitem,orders,part,supplier'), ('nation', 'nation,region'),
('orders', 'customer,orders'), ('supplier', 'nation,supplier')) t(center, tables)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k.split(":")[0], ",".join(sorted(v))) for k, v in testdata().hypergraph().items()], "center string, tables string")


@query("schema_fk_columns", "SELECT * FROM (VALUES ('customer', 'c_nationkey'), ('lineitem', 'l_orderkey'), ('lineitem', 'l_partkey'), ('lineitem', 'l_suppkey'), ('nation', 'n_regionkey'), ('orders', 'o_custkey'), ('supplier', 's_nationkey')) t(child, fk)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = testdata()
    return spark.createDataFrame([(t, c) for t in s.tables for c in s.fk_columns(t)], "child string, fk string")


@query("schema_search_order", "SELECT * FROM (VALUES (1, 'customer', NULL), (2, 'nation', 'customer'), (3, 'orders', 'customer'), (4, 'region', 'nation'), (5, 'lineitem', 'orders'), (6, 'part', 'lineitem'), (7, 'supplier', 'lineitem')) t(place, tab, above)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first from a root, over the universal relation."""
    from .catalog import _UR

    return spark.createDataFrame([(k + 1, t, above) for k, (t, _, above) in enumerate(breadth_first("customer", _UR.edges))], "place int, tab string, above string")


@query("schema_dot", "SELECT parent || '>' || child AS edge FROM (VALUES ('region', 'nation'), ('nation', 'customer'), ('nation', 'supplier'), ('customer', 'orders'), ('orders', 'lineitem'), ('part', 'lineitem'), ('supplier', 'lineitem')) t(parent, child)")
def _(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.createDataFrame([(x,) for x in testdata().dot().splitlines() if "->" in x], "line string")
    found = [F.regexp_extract("line", r'"(\w+)" -> "(\w+)"', k) for k in (1, 2)]
    return lines.select(F.concat(found[0], F.lit(">"), found[1]).alias("edge"))


@query("cin_plans", """SELECT * FROM (VALUES ('one', 1, 'customer', NULL), ('two', 1, 'orders', NULL), ('three', 1, 'lineitem', NULL), ('three', 2, 'orders', 'orders'),
('four', 1, 'lineitem', NULL), ('four', 2, 'orders', 'orders'), ('region', 1, 'nation', NULL)) t(query, place, center, common)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhoods of each query: the largest first, each later one joined by a common table, unused tables left out."""
    db = database(spark, d)
    asked = ESTIMATED | {"region": "SELECT COUNT(*) FROM region r WHERE r.r_regionkey > 1"}
    rows = [(k, n + 1, x.sub.center, x.common) for k, q in asked.items() for n, x in enumerate(estimators.neighbourhood_plan(db, db.bind(q)))]
    return spark.createDataFrame(rows, "query string, place int, center string, common string")


@query("cin_exact_estimate_parent", "SELECT COUNT(*) AS cnt FROM part WHERE p_size < 20")
def _(spark: SparkSession, d: str) -> DataFrame:
    """One referred table, through the neighbourhood in which its rows stand once for each referring one."""
    return estimators.neighbourhood_exact(database(spark, d), "SELECT COUNT(*) FROM part p WHERE p.p_size < 20")


@query("bound_edges", "SELECT * FROM (VALUES ('nation.n_nationkey=customer.c_nationkey', FALSE), ('nation.n_nationkey=supplier.s_nationkey', FALSE), ('nation', TRUE)) t(what, added)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two columns that refer to one key, joined through its table."""
    b = database(spark, d).bind(SPJ["spj_fkfk_translate"])
    return spark.createDataFrame([(e.condition, False) for e in b.edges] + [(t, True) for t in b.added], "what string, added boolean")


@query("natural_order", "SELECT * FROM (VALUES (1, 'epoch-1.pt'), (2, 'epoch-2.pt'), (3, 'epoch-10.pt'), (4, 'epoch-10b.pt')) t(place, file)")
def _(spark: SparkSession, d: str) -> DataFrame:
    files = ["epoch-10b.pt", "epoch-10.pt", "epoch-2.pt", "epoch-1.pt"]
    return spark.createDataFrame([(k + 1, x) for k, x in enumerate(sorted(files, key=evaluation.natural))], "place int, file string")


@query("sample_sizes", "SELECT size, GREATEST(100000, LEAST(500000, size)) AS n FROM (SELECT UNNEST([0, 99999, 100001, 500000, 7000000]::BIGINT[]) AS size)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x, sampling.sample_size(x)) for x in (0, 99_999, 100_001, 500_000, 7_000_000)], "size long, n long")


@query("validation_split", "SELECT * FROM (VALUES (5::BIGINT, 5::BIGINT, 0::BIGINT), (1000, 900, 100), (250000, 240000, 10000)) t(n, train, held)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for n in (5, 1000, 250_000):
        train, held = density.split(np.arange(n)[:, None], 1)
        assert len(np.unique(np.concatenate([train, held]))) == n
        rows.append((n, len(train), len(held)))
    return spark.createDataFrame(rows, "n long, train long, held long")


@query("training_masks", "SELECT * FROM (VALUES (1, 4), (2, 4), (3, 4)) t(hidden, columns)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """1 to all but one columns are hidden in every row of a batch."""
    hidden = density.masks(np.random.default_rng(3), 500, 4)
    return spark.createDataFrame([(int(k), hidden.shape[1]) for k in np.unique(hidden.sum(1))], "hidden int, columns int")


@query("literal_types", "SELECT * FROM (VALUES (1, 'int'), (2, 'float'), (3, 'str'), (4, 'datetime'), (5, 'NoneType'), (6, 'tuple')) t(place, kind)")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = database(spark, d).parse("SELECT COUNT(*) FROM orders o WHERE o.o_orderkey > 5 AND o.o_totalprice < 1.5e3 AND o.o_orderstatus = 'a''b' AND o.o_orderdate >= '1995-01-01' AND o.o_custkey IS NULL AND o.o_orderpriority IN ('x', 'y')")
    assert q.predicates[3].value == datetime(1995, 1, 1)
    return spark.createDataFrame([(k + 1, type(p.value).__name__) for k, p in enumerate(q.predicates)], "place int, kind string")


@query("alias_tables", "SELECT * FROM (VALUES ('o', 'orders'), ('l', 'lineitem'), ('inner_part', 'part'), ('nation', 'nation')) t(alias, tab)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Tables by alias: comma lists, JOIN ... ON, sub-selects, quoted names."""
    from .sqlparse import alias_tables

    found = alias_tables('SELECT * FROM orders o LEFT JOIN "lineitem" AS l ON o.o_orderkey = l.l_orderkey, (SELECT p_partkey FROM part inner_part WHERE p_size > 3) x JOIN nation ON true')
    return spark.createDataFrame(sorted(found.items()), "alias string, tab string")


# ---- learned models --------------------------------------------------------------------------------------------------------


@query("model_round_trip", "SELECT * FROM (VALUES (1, TRUE, TRUE), (2, TRUE, TRUE)) t(epoch, same, bounded)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A model chosen from two configurations, stored with every epoch, loaded, and evaluated epoch by epoch: the last
    answers as the one in memory does, and no answer exceeds the relation."""
    from .learned import LearnedNeighbourhoods, epochs_of

    db = _chain(database(spark, d))
    path, names = new_path(spark, "model"), ["orders:o_custkey=customer.c_custkey"]
    configs = [density.Config([1], epochs=2, d_word=w) for w in (8, 16)]
    model = LearnedNeighbourhoods.fit(db, names, n=4000, config=configs, every_epoch=True, samples=500, stages=Stages(db.schema, db.tables, new_path(spark, "stages"), d))
    model.save(path)
    asked = [(100, ESTIMATED["two"].replace("c.c_acctbal > 1000", "c.c_mktsegment = 'BUILDING'")), (10, "SELECT COUNT(*) FROM customer c WHERE c.c_mktsegment = 'MACHINERY'")]

    def load(epoch: int) -> LearnedNeighbourhoods:
        return LearnedNeighbourhoods.load(db, path, db.schema.neighbourhoods(), epoch, samples=500)

    found = evaluation.evaluate_epochs(db, load, epochs_of(db, path), asked)
    now = evaluation.evaluate_together(db, "now", model.estimates, asked).select("query_no", F.col("estimated_cardinality").alias("now"))
    size = db.tables["orders"].count()
    rows = found.join(F.broadcast(now), "query_no").groupBy("epoch").agg(
        F.every((F.col("epoch") == 1) | (F.col("now") == F.col("estimated_cardinality"))).alias("same"), F.every(F.col("estimated_cardinality").between(0, size)).alias("bounded")
    )
    return rows.select("epoch", "same", "bounded")

"""Queries over the test tables, one for each capability, with SQL for what SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, measures
from ..functions.predicates import Predicate, conjunction, like
from ..operators import sampling, statistics
from ..operators.graph import FkDef, Schema
from ..operators.statistics import name
from ..sources.loaders import read_tables
from ..sources.schemas import CYCLE, testdata
from . import estimators, evaluation
from .database import Database

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[key] = f
        if sql:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def database(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, testdata(), read_tables(spark, sf_dir, testdata()))


# ---- exact counts ----------------------------------------------------------------------------------------------------

SPJ = {
    "spj_count_2way": "SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 1000",
    "spj_count_3way": "SELECT COUNT(*) FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND o.o_orderdate >= '1995-01-01'::timestamp",
    "spj_count_4way": "SELECT COUNT(*) FROM customer c, orders o, lineitem l, part p WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND p.p_partkey = l.l_partkey AND p.p_size < 20 AND c.c_mktsegment = 'BUILDING'",
    "spj_count_5way": "SELECT COUNT(*) FROM nation n, customer c, orders o, lineitem l, part p WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND p.p_partkey = l.l_partkey AND n.n_regionkey <= 2 AND l.l_quantity > 10",
    "spj_range": "SELECT COUNT(*) FROM lineitem l WHERE l.l_quantity >= 10 AND l.l_quantity < 30 AND l.l_discount <= 0.05",
    "spj_eq": "SELECT COUNT(*) FROM orders o WHERE o.o_orderstatus = 'O'",
    "spj_neq": "SELECT COUNT(*) FROM orders o WHERE o.o_orderstatus <> 'O'",
    "spj_in": "SELECT COUNT(*) FROM part p, lineitem l WHERE p.p_partkey = l.l_partkey AND p.p_size IN (1, 5, 9, 100)",
    "spj_not_in": "SELECT COUNT(*) FROM part p WHERE p.p_size NOT IN (1, 5, 9)",
    "spj_between": "SELECT COUNT(*) FROM orders o WHERE o.o_totalprice BETWEEN 1000 AND 200000.5",
    "spj_like": "SELECT COUNT(*) FROM part p WHERE p.p_type LIKE '%S%' AND p.p_name LIKE '_%a%'",
    "spj_not_like": "SELECT COUNT(*) FROM part p WHERE p.p_type NOT LIKE '%S%'",
    "spj_join_on": "SELECT COUNT(*) FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'",
    "spj_cycle": "SELECT COUNT(*) FROM customer c, orders o, lineitem l, supplier s WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey",
    "spj_fkfk_translate": "SELECT COUNT(*) FROM customer c, supplier s WHERE c.c_nationkey = s.s_nationkey AND c.c_acctbal > 0",
}


def _as_cnt(sql: str) -> str:
    return sql.replace("COUNT(*)", "COUNT(*) AS cnt", 1)


for _key, _sql in SPJ.items():
    if _key == "spj_fkfk_translate":  # through the table that both columns refer to
        query(_key, _as_cnt(_sql))(lambda spark, d, sql=_sql: database(spark, d).count_messages(sql))
    else:
        query(_key, _as_cnt(_sql))(lambda spark, d, sql=_sql: database(spark, d).count(sql))

for _key in ("spj_count_2way", "spj_count_3way", "spj_count_4way", "spj_count_5way"):
    query(f"count_by_messages_{_key[-4:]}", _as_cnt(SPJ[_key]))(lambda spark, d, sql=SPJ[_key]: database(spark, d).count_messages(sql))


def _nulled(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["orders"]
    return t.withColumn("status", F.nullif("o_orderstatus", F.lit("O")))


for _key, _op, _value, _where in [
    ("spj_is_null", "IS", None, "status IS NULL"), ("spj_is_not_null", "IS NOT", None, "status IS NOT NULL"), ("spj_eq_null", "=", None, "status IS NULL"),
    ("spj_neq_null", "!=", None, "status IS NOT NULL"), ("spj_is_value", "IS", "F", "status IS NOT DISTINCT FROM 'F'"), ("spj_is_not_value", "IS NOT", "F", "status IS DISTINCT FROM 'F'"),
    ("spj_neq_with_nulls", "!=", "F", "status <> 'F'"),
]:
    query(_key, f"SELECT COUNT(*) AS cnt FROM (SELECT NULLIF(o_orderstatus, 'O') AS status FROM orders) WHERE {_where}")(
        lambda spark, d, p=Predicate("orders", "status", _op, _value): _nulled(spark, d).where(conjunction([p], lambda p: F.col(p.column))).agg(F.count(F.lit(1)).alias("cnt"))
    )


# ---- fanouts, weights, sizes -----------------------------------------------------------------------------------------


@query("fk_value_counts", "SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY l_partkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return statistics.fk_value_counts(database(spark, d).tables["lineitem"], "l_partkey")


@query("adj_fanout_pk", "SELECT o_orderkey, COALESCE(n, 1) AS fanout FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    df = statistics.with_adjacent_fanouts("orders", db.tables, db.schema.edges_between("orders", "lineitem"))
    return df.select("o_orderkey", name("orders.__adj_fanout__:o_orderkey=lineitem.l_orderkey").alias("fanout"))


@query("adj_fanout_fk", "SELECT l_orderkey, CAST(1 AS BIGINT) AS fanout FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    df = statistics.with_adjacent_fanouts("lineitem", db.tables, db.schema.edges_between("orders", "lineitem"))
    return df.select("l_orderkey", name("lineitem.__adj_fanout__:l_orderkey=orders.o_orderkey").alias("fanout"))


_CHAIN = [FkDef("customer", "c_custkey", "orders", "o_custkey"), FkDef("orders", "o_orderkey", "lineitem", "l_orderkey")]
_ORDER_WEIGHT = "SELECT o_orderkey, o_custkey, COALESCE(n, 1) AS w FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


@query("subtree_weight_orders", f"SELECT o_orderkey, CAST(w AS BIGINT) AS weight FROM ({_ORDER_WEIGHT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.subtree_weights(database(spark, d).tables, _CHAIN, "customer", "orders")
    return df.select("o_orderkey", F.col("__weight__").cast("long").alias("weight"))


@query("subtree_weight_customer", f"SELECT c_custkey, CAST(COALESCE(s, 1) AS BIGINT) AS weight FROM customer LEFT JOIN (SELECT o_custkey, SUM(w) AS s FROM ({_ORDER_WEIGHT}) GROUP BY 1) ON c_custkey = o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.subtree_weights(database(spark, d).tables, _CHAIN, "customer", "customer")
    return df.select("c_custkey", F.col("__weight__").cast("long").alias("weight"))


def _full(edges: list[FkDef], root: str) -> str:
    from ..operators.graph import breadth_first

    sql = root
    for t, e, above in breadth_first(root, edges)[1:]:
        sql += f" FULL JOIN {t} ON {above}.{e.column_of(above)} = {t}.{e.column_of(t)}"
    return sql


for _sub in testdata().neighbourhoods():
    query(f"join_size_cin_{_sub.center}", f"SELECT COUNT(*) AS size FROM {_full(list(_sub.edges), _sub.root)}")(
        lambda spark, d, sub=_sub: statistics.full_outer_size({t: database(spark, d).tables[t] for t in sub.tables}, sub.edges, sub.root)
    )

_UR = testdata().universal([CYCLE])


@query("join_size_ur", f"SELECT COUNT(*) AS size FROM {_full(list(_UR.edges), _UR.root)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return statistics.full_outer_size(database(spark, d).tables, _UR.edges, _UR.root)


@query("join_size_reachable", "SELECT COUNT(*) AS size FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return statistics.reachable_size(database(spark, d).tables, _CHAIN, "lineitem")


@query("full_outer_markers", "SELECT c_custkey IS NOT NULL AS has_customer, o_orderkey IS NOT NULL AS has_orders, l_orderkey IS NOT NULL AS has_lineitem, COUNT(*) AS n FROM customer FULL JOIN orders ON c_custkey = o_custkey FULL JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.full_outer_join(database(spark, d).tables, _CHAIN, "customer")
    return df.groupBy(*[name(f"__in__:{t}").alias(f"has_{t}") for t in ("customer", "orders", "lineitem")]).agg(F.count(F.lit(1)).alias("n"))


@query("fk_conditional_weights", f"SELECT o_orderkey, ROUND(w / SUM(w) OVER (PARTITION BY o_custkey), 9) AS share FROM ({_ORDER_WEIGHT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.subtree_weights(database(spark, d).tables, _CHAIN, "customer", "orders")
    return statistics.conditional_weights(df, "o_custkey", "__weight__").select("o_orderkey", F.round("share", 9).alias("share"))


@query("log2_fanout", f"SELECT o_orderkey, ROUND(CASE WHEN w <= 1 THEN 0.000001 ELSE LOG2(w) END, 6) AS lg FROM ({_ORDER_WEIGHT})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.subtree_weights(database(spark, d).tables, _CHAIN, "customer", "orders")
    return df.select("o_orderkey", F.round(codes.log_fanout(F.col("__weight__")), 6).alias("lg"))


# ---- dictionaries ----------------------------------------------------------------------------------------------------


@query("distinct_vals", "SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distinct_values(database(spark, d).tables["part"], "p_type")


@query("domain_sizes", "SELECT 'p_type' AS col, COUNT(DISTINCT p_type) + 2 AS domain FROM part UNION ALL SELECT 'p_size', COUNT(DISTINCT p_size) + 2 FROM part UNION ALL SELECT 'l_extendedprice', COUNT(DISTINCT l_extendedprice) + 2 FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables
    parts = [statistics.domain_size(t[x], c).select(F.lit(c).alias("col"), "domain") for x, c in (("part", "p_type"), ("part", "p_size"), ("lineitem", "l_extendedprice"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


_NULLED = "SELECT o_orderkey, NULLIF(o_orderstatus, 'O') AS status FROM orders"
_CODED = f"SELECT o.o_orderkey, o.status, COALESCE(d.code, 1) AS code FROM ({_NULLED}) o LEFT JOIN (SELECT status, DENSE_RANK() OVER (ORDER BY status) + 1 AS code FROM (SELECT DISTINCT status FROM ({_NULLED}) WHERE status IS NOT NULL)) d ON d.status = o.status"


def _encoded_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    df = _nulled(spark, d).select("o_orderkey", "status")
    found = statistics.dictionary(df, "status")
    return statistics.encode(df, "status", found), found


@query("dictionary_codes", "SELECT value, DENSE_RANK() OVER (ORDER BY value) + 1 AS code FROM (SELECT DISTINCT l_extendedprice AS value FROM lineitem)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return statistics.dictionary(database(spark, d).tables["lineitem"], "l_extendedprice")


@query("dictionary_encode", f"SELECT o_orderkey, status, CAST(code AS BIGINT) AS code FROM ({_CODED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _encoded_orders(spark, d)[0]


@query("dictionary_decode", f"SELECT o_orderkey, status AS value FROM ({_NULLED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df, found = _encoded_orders(spark, d)
    return statistics.decode(df, "code", found).select("o_orderkey", "value")


@query("dictionary_ood", "SELECT p.p_partkey, CAST(COALESCE(d.code, 1) AS BIGINT) AS code FROM part p LEFT JOIN (SELECT p_size, DENSE_RANK() OVER (ORDER BY p_size) + 1 AS code FROM (SELECT DISTINCT p_size FROM part WHERE p_size <= 25)) d ON d.p_size = p.p_size")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["part"]
    return statistics.encode(t, "p_size", statistics.dictionary(t.where("p_size <= 25"), "p_size")).select("p_partkey", "code")


@query("dictionary_drop_ood", "SELECT p_partkey FROM part WHERE p_size <= 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["part"]
    return statistics.encode(t, "p_size", statistics.dictionary(t.where("p_size <= 25"), "p_size"), drop_unknown=True).select("p_partkey")


_PRICE_CODES = "SELECT l_extendedprice AS value, DENSE_RANK() OVER (ORDER BY l_extendedprice) + 1 AS code FROM (SELECT DISTINCT l_extendedprice FROM lineitem)"
#: A slice of a code by its place: three near equal slices of the bits that the dictionary's size needs, the lowest takes what is left over.
_BITS = "(SELECT LENGTH(BIN(COUNT(DISTINCT l_extendedprice) + 1)) AS bits FROM lineitem)"
_SLICED = f"""SELECT value, slice, CASE slice WHEN 0 THEN code % (1 << low)::BIGINT ELSE (code // (1 << (low + (slice - 1) * each))::BIGINT) % (1 << each)::BIGINT END + 1 AS part
FROM ({_PRICE_CODES}), (SELECT (bits // n)::INT AS each, (bits - bits // n * (n - 1))::INT AS low, n FROM (SELECT bits, ((bits + 7) // 8)::INT AS n FROM {_BITS})), UNNEST(RANGE(n)) t(slice)"""


@query("factorize_bits", f"SELECT value, slice::INT AS slice, part::BIGINT AS part FROM ({_SLICED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.dictionary(database(spark, d).tables["lineitem"], "l_extendedprice")
    slices = codes.factorize(df.count() + codes.FIRST, 8)
    parts = F.array(*[F.struct(F.lit(s.index).alias("slice"), codes.slice_code(F.col("code"), s).cast("long").alias("part")) for s in slices])
    return df.select("value", F.explode(parts).alias("p")).select("value", "p.*")


@query("factorize_reconstruct", f"SELECT value, CAST(code AS BIGINT) AS code FROM ({_PRICE_CODES})")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = statistics.dictionary(database(spark, d).tables["lineitem"], "l_extendedprice")
    slices = codes.factorize(df.count() + codes.FIRST, 8)
    cut = df.select("value", *[codes.slice_code(F.col("code"), s).alias(f"s{s.index}") for s in slices])
    return cut.select("value", codes.join_slices([F.col(f"s{s.index}") for s in slices], slices).alias("code"))


# ---- predicates on dictionaries ----------------------------------------------------------------------------------------

_PREDICATES = [
    Predicate("part", "p_size", "<", 20), Predicate("part", "p_type", "LIKE", "%S%"), Predicate("part", "p_brand", "=", "Brand#12"),
    Predicate("lineitem", "l_returnflag", "IN", ("A", "R")),
]
_MATCHES = "SELECT 'part.p_size' AS col, COUNT(*) AS m FROM (SELECT DISTINCT p_size FROM part) WHERE p_size < 20 UNION ALL SELECT 'part.p_type', COUNT(*) FROM (SELECT DISTINCT p_type FROM part) WHERE p_type LIKE '%S%' UNION ALL SELECT 'part.p_brand', COUNT(*) FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand = 'Brand#12' UNION ALL SELECT 'lineitem.l_returnflag', COUNT(*) FROM (SELECT DISTINCT l_returnflag FROM lineitem) WHERE l_returnflag IN ('A', 'R')"


@query("pred_match_counts", _MATCHES)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables
    out = None
    for p in _PREDICATES:
        values = t[p.table].select(name(p.column)).distinct()
        one = values.where(conjunction([p], lambda p: name(p.column))).agg(F.lit(p.name).alias("col"), F.count(F.lit(1)).alias("m")).select("col", "m")
        out = one if out is None else out.unionAll(one)
    return out


_DOMAINS = "SELECT 'part.p_size' AS col, COUNT(DISTINCT p_size) + 2 AS n FROM part UNION ALL SELECT 'part.p_type', COUNT(DISTINCT p_type) + 2 FROM part UNION ALL SELECT 'part.p_brand', COUNT(DISTINCT p_brand) + 2 FROM part UNION ALL SELECT 'lineitem.l_returnflag', COUNT(DISTINCT l_returnflag) + 2 FROM lineitem"


_PLACE = "CASE col WHEN 'part.p_brand' THEN 1 WHEN 'part.p_type' THEN 2 WHEN 'part.p_size' THEN 3 ELSE 4 END"
for _key, _rank in (("prop", "m"), ("prop-inv", "-m"), ("prop-ratio", "m / n"), ("domain-size", "n"), ("nat", _PLACE), ("inv", f"-({_PLACE})")):
    query(
        f"pred_order_{_key.replace('-', '_')}",
        f"SELECT col, ROW_NUMBER() OVER (ORDER BY {_rank}, CASE col WHEN 'part.p_brand' THEN 1 WHEN 'part.p_type' THEN 2 WHEN 'part.p_size' THEN 3 ELSE 4 END) AS place FROM ({_MATCHES}) JOIN ({_DOMAINS}) USING (col)",
    )(lambda spark, d, order=_key: spark.createDataFrame(
        [(c, k + 1) for k, c in enumerate(estimators.predicate_order(database(spark, d), _PREDICATES, order))], "col string, place long"
    ))


@query("pred_mask_like_to_in", "SELECT DISTINCT p_type AS value FROM part WHERE p_type LIKE '%S%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distinct_values(database(spark, d).tables["part"], "p_type").where(like(F.col("value"), "%S%"))


@query("empirical_selectivity", "SELECT ROUND(AVG(CASE WHEN o_orderkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_quantity > 10 AND o_totalprice < 200000 THEN 1.0 ELSE 0.0 END), 9) AS selectivity FROM orders FULL JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    b = db.bind("SELECT COUNT(*) FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND l.l_quantity > 10 AND o.o_totalprice < 200000")
    df = statistics.full_outer_join(db.tables, b.edges, "orders")
    return df.agg(F.round(F.avg(F.when(estimators.qualifies(b), 1.0).otherwise(0.0)), 9).alias("selectivity"))


# ---- estimators --------------------------------------------------------------------------------------------------------

ESTIMATED = {
    "one": "SELECT COUNT(*) FROM customer c WHERE c.c_acctbal > 5000",
    "two": "SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 1000",
    "three": "SELECT COUNT(*) FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_quantity > 25 AND c.c_mktsegment = 'BUILDING'",
    "four": SPJ["spj_count_4way"],
}
for _key, _sql in ESTIMATED.items():
    query(f"ur_exact_estimate_{_key}", _as_cnt(_sql))(lambda spark, d, sql=_sql: estimators.universal_exact(database(spark, d), _UR, sql))
    query(f"cin_exact_estimate_{_key}", _as_cnt(_sql))(lambda spark, d, sql=_sql: estimators.neighbourhood_exact(database(spark, d), sql))


_JOINED = "customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"


@query("join_sample", f"SELECT 100000::BIGINT AS n, TRUE AS rows_are_real, TRUE AS keys_match, TRUE AS near_uniform FROM (SELECT COUNT(*) FROM {_JOINED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """100,000 draws: every drawn row of a table is one of its rows, keys match, and shares of the sample are those of the
    outer join within five standard deviations."""
    db = database(spark, d)
    n = sampling.sample_size(0)
    found = sampling.sample_join(db.tables, _CHAIN, "customer", n)
    lines = db.tables["lineitem"]
    real = found.join(
        lines.select(F.xxhash64(*lines.columns).alias("_h")).distinct(), F.xxhash64(*[name(f"lineitem.{c}") for c in lines.columns]) == F.col("_h"), "left"
    )
    share = db.tables["customer"].join(db.tables["orders"], F.col("c_custkey") == F.col("o_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    share = share.agg(*[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"t{k}") for k, c in enumerate((F.col("c_mktsegment") == "BUILDING", F.col("l_quantity") > 25))])
    inside = F.lit(True)
    for k in range(2):
        inside = inside & (F.abs(F.col(f"s{k}") - F.col(f"t{k}")) <= 5 * F.sqrt(F.col(f"t{k}") * (1 - F.col(f"t{k}")) / n) + 1e-9)
    got = real.agg(
        F.count(F.lit(1)).alias("n"), F.every(F.coalesce("_h", F.lit(0)).eqNullSafe(F.lit(0)) != name("__in__:lineitem")).alias("rows_are_real"),
        F.every(F.coalesce(name("customer.c_custkey") == name("orders.o_custkey"), ~name("__in__:orders")) & F.coalesce(name("orders.o_orderkey") == name("lineitem.l_orderkey"), ~name("__in__:lineitem"))).alias("keys_match"),
        *[F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"s{k}") for k, c in enumerate((name("customer.c_mktsegment") == "BUILDING", name("lineitem.l_quantity") > 25))],
    )
    return got.crossJoin(share).select("n", "rows_are_real", "keys_match", inside.alias("near_uniform"))  # one row each


def _within(db: Database, sql: str, estimate: DataFrame, bound: float) -> DataFrame:
    """The count, and whether the estimate's q-error is within the bound."""
    found = db.count(sql).crossJoin(estimate.toDF("estimate"))  # one row each
    return found.select("cnt", (measures.q_error(F.col("estimate"), F.col("cnt")) <= bound).alias("within"))


def _bounded(sql: str) -> str:
    return sql.replace("COUNT(*)", "COUNT(*) AS cnt, TRUE AS within", 1)


def _sizes(db: Database, sub) -> int:  # noqa: ANN001
    tables = {t: db.tables[t] for t in sub.tables}
    return sampling.sample_size(int(statistics.reachable_size(tables, sub.edges, sub.root).first()["size"]))


@query("ur_sampled_estimate", _bounded(ESTIMATED["three"]))
def _(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    return _within(db, ESTIMATED["three"], estimators.universal_sampled(db, _UR, ESTIMATED["three"], n=_sizes(db, _UR)), 1.5)


@query("cin_sampled_estimate", _bounded(ESTIMATED["three"]))
def _(spark: SparkSession, d: str) -> DataFrame:
    db = database(spark, d)
    return _within(db, ESTIMATED["three"], estimators.neighbourhood_sampled(db, ESTIMATED["three"]), 1.5)


def _chain(db: Database) -> Database:
    """Customers, orders and lines with the columns that models of them learn."""
    s = Schema("chain")
    for t, columns in (("customer", ["c_custkey", "c_mktsegment", "c_nationkey"]), ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]), ("lineitem", ["l_orderkey", "l_quantity"])):
        s.add_table(t, columns)
    for e in _CHAIN:
        s.add_relationship(e.parent, e.pk, e.child, e.fk)
    return Database(db.spark, s, {t: db.tables[t].select(*s.tables[t].columns) for t in s.tables})


_LEARNED_UR = "SELECT COUNT(*) FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND o.o_orderstatus = 'O' AND c.c_mktsegment = 'BUILDING'"


def _learned(continuous: bool) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        from .learned import LearnedUniversal

        db = _chain(database(spark, d))
        sub = db.schema.universal()
        return _within(db, _LEARNED_UR, LearnedUniversal.fit(db, sub, n=_sizes(db, sub), continuous=continuous).estimate(_LEARNED_UR), 2.0)

    return run


query("nar_mlp_estimate", _bounded(_LEARNED_UR))(_learned(False))
query("nar_continuous_estimate", _bounded(_LEARNED_UR))(_learned(True))


@query("cin_learned_estimate", _bounded(ESTIMATED["three"]))
def _(spark: SparkSession, d: str) -> DataFrame:
    from .learned import LearnedNeighbourhoods

    db = _chain(database(spark, d))
    return _within(db, ESTIMATED["three"], LearnedNeighbourhoods.fit(db).estimate(ESTIMATED["three"]), 2.0)


# ---- evaluation --------------------------------------------------------------------------------------------------------

_ERRORS = "SELECT o_orderkey, o_custkey % 50 AS est, o_orderkey % 40 AS truth FROM orders"
_Q = "CASE WHEN est = 0 AND truth = 0 THEN 1.0::DOUBLE WHEN est = 0 THEN truth::DOUBLE WHEN truth = 0 THEN est::DOUBLE ELSE GREATEST(est::DOUBLE / truth, truth::DOUBLE / est) END"


def _errors(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["orders"]
    return t.select("o_orderkey", measures.q_error(F.col("o_custkey") % 50, F.col("o_orderkey") % 40).alias("q_err"))


@query("q_error", f"SELECT o_orderkey, ROUND({_Q}, 9) AS q_err FROM ({_ERRORS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).select("o_orderkey", F.round("q_err", 9).alias("q_err"))


@query("q_error_quantiles", f"SELECT q AS quantile, ROUND(LIST_SORT(LIST(e))[round_even(q * (COUNT(*) - 1), 0)::INT + 1], 9) AS value FROM (SELECT {_Q} AS e FROM ({_ERRORS})), (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) t(q) GROUP BY q")
def _(spark: SparkSession, d: str) -> DataFrame:
    return measures.nearest_quantiles(_errors(spark, d), "q_err").select("quantile", F.round("value", 9).alias("value"))


@query("report_stats", f"SELECT ROUND(MAX(e), 6) AS max_err, ROUND(QUANTILE_CONT(e, 0.99), 6) AS p99_err, ROUND(QUANTILE_CONT(e, 0.95), 6) AS p95_err, ROUND(QUANTILE_CONT(e, 0.9), 6) AS p90_err, ROUND(QUANTILE_CONT(e, 0.5), 6) AS p50_err, ROUND(AVG(e), 6) AS mean_err FROM (SELECT {_Q} AS e FROM ({_ERRORS}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    df = measures.report(_errors(spark, d), "q_err")
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("entropy", "SELECT ROUND(-SUM(p * LOG2(p)), 6) AS entropy FROM (SELECT COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM lineitem GROUP BY l_quantity)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return measures.entropy(database(spark, d).tables["lineitem"], "l_quantity").select(F.round("entropy", 6).alias("entropy"))


@query("join_order_json", """SELECT o_orderkey, '[' || '"t",["c' || (o_orderkey % 7) || '","k_' || (o_orderkey % 3) || '"]' || ']' AS js FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = database(spark, d).tables["orders"]
    made = F.concat(F.lit("Leading(t (c"), (F.col("o_orderkey") % 7).cast("string"), F.lit(" k_"), (F.col("o_orderkey") % 3).cast("string"), F.lit("))"))
    return t.select("o_orderkey", measures.join_order_json(made).alias("js"))


@query("schema_edges", """SELECT * FROM (VALUES ('region', 'r_regionkey', 'nation', 'n_regionkey'), ('nation', 'n_nationkey', 'customer', 'c_nationkey'),
('nation', 'n_nationkey', 'supplier', 's_nationkey'), ('customer', 'c_custkey', 'orders', 'o_custkey'), ('orders', 'o_orderkey', 'lineitem', 'l_orderkey'),
('part', 'p_partkey', 'lineitem', 'l_partkey'), ('supplier', 's_suppkey', 'lineitem', 'l_suppkey')) t(parent, pk, child, fk)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(e.parent, e.pk, e.child, e.fk) for e in testdata().fks], "parent string, pk string, child string, fk string")


@query("cin_catalog", "SELECT * FROM (VALUES ('customer:c_nationkey=nation.n_nationkey', 'customer', 2), ('lineitem:l_orderkey=orders.o_orderkey:l_partkey=part.p_partkey:l_suppkey=supplier.s_suppkey', 'lineitem', 4), ('nation:n_regionkey=region.r_regionkey', 'nation', 2), ('orders:o_custkey=customer.c_custkey', 'orders', 2), ('supplier:s_nationkey=nation.n_nationkey', 'supplier', 2)) t(name, center, tables)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(s.name, s.center, len(s.tables)) for s in testdata().neighbourhoods()], "name string, center string, tables int")


@query("true_subquery_cards", """
WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders), l AS (SELECT * FROM lineitem WHERE l_quantity > 25)
SELECT 'customer' AS tables, COUNT(*) AS cnt FROM c UNION ALL SELECT 'orders', COUNT(*) FROM o UNION ALL SELECT 'lineitem', COUNT(*) FROM l
UNION ALL SELECT 'customer,orders', COUNT(*) FROM c JOIN o ON c_custkey = o_custkey UNION ALL SELECT 'lineitem,orders', COUNT(*) FROM o JOIN l ON o_orderkey = l_orderkey
UNION ALL SELECT 'customer,lineitem,orders', COUNT(*) FROM c JOIN o ON c_custkey = o_custkey JOIN l ON o_orderkey = l_orderkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.true_cardinalities(database(spark, d), ESTIMATED["three"])


_COST = """SELECT '{key}' AS query_no, ROUND((CASE WHEN o * c / n_c / {fc} < l / {fl} THEN co ELSE ol END + col)::DOUBLE / (LEAST(co, ol) + col), 6) AS p_err FROM (
  SELECT (SELECT COUNT(*) FROM customer) AS n_c, (SELECT COUNT(*) FROM customer) AS c, (SELECT COUNT(*) FROM orders) AS o, (SELECT COUNT(*) FROM lineitem) AS l,
    (SELECT COUNT(*) FROM fc JOIN orders ON c_custkey = o_custkey) AS co, (SELECT COUNT(*) FROM orders JOIN fl ON o_orderkey = l_orderkey) AS ol,
    (SELECT COUNT(*) FROM fc JOIN orders ON c_custkey = o_custkey JOIN fl ON o_orderkey = l_orderkey) AS col)"""
_ONE_ORDER = "SELECT COUNT(*) FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_shipdate < '1995-06-01' AND l.l_returnflag = 'A' AND l.l_discount > 0.07 AND c.c_acctbal > -500"
_F = "WITH fc AS (SELECT * FROM customer WHERE {c}), fl AS (SELECT * FROM lineitem WHERE {l}) "


@query(
    "p_error_cout",
    "SELECT * FROM (" + _F.format(c="c_mktsegment = 'BUILDING'", l="l_quantity > 25") + _COST.format(key="1", fc=3, fl=3)
    + ") UNION ALL SELECT * FROM (" + _F.format(c="c_acctbal > -500", l="l_shipdate < TIMESTAMP '1995-06-01' AND l_returnflag = 'A' AND l_discount > 0.07") + _COST.format(key="2", fc=3, fl=27) + ")",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Plan-cost error of estimates that take every table for independent of the others, by sub-queries as a file has them."""
    db = database(spark, d)
    sizes = {t: db.tables[t].count() for t in ("customer", "orders", "lineitem")}
    rows = []
    for key, sql in (("1", ESTIMATED["three"]), ("2", _ONE_ORDER)):
        b = db.bind(sql)
        truth = {r.tables: int(r.cnt) for r in evaluation.true_cardinalities(db, sql).collect()}
        for chosen, edges in evaluation.connected_subsets(b):
            guess = 1.0
            for t in chosen:
                guess *= sizes[t] / 3 ** sum(p.table == t for p in b.predicates)
            for e in edges:
                guess /= sizes[e.parent]
            node = ",".join(sorted(chosen))
            rows.append((key, node, guess, truth[node], sql))
    cards = spark.createDataFrame(rows, "name string, node string, estimate double, true_cardinality long, sql string")
    return evaluation.plan_cost_errors_of(db, cards).select("query_no", F.round("p_err", 6).alias("p_err"))


from . import catalog_more  # noqa: E402, F401  registers the rest

"""Running a benchmark: q-errors and their quantiles, true sub-query counts, join orders and plan-cost errors."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import nearest_quantiles, q_error, report
from ..operators.graph import FkDef, is_tree
from .database import Bound, Database

RESULT = "estimator string, query_no int, q_err double, estimated_cardinality long, true_cardinality long, elapsed_time_ms double"
Estimate = Callable[[str], DataFrame]


def evaluate(db: Database, estimator: str, estimate: Estimate, benchmark: Iterable[tuple[int, str]]) -> DataFrame:
    """One row a query of ``benchmark`` (true cardinality, sql). A benchmark is a list of queries; each estimate is one Spark job."""
    rows = []
    for k, (truth, sql) in enumerate(benchmark):
        start = time.perf_counter()
        found = estimate(sql).first()
        rows.append((estimator, k, int(found[0]), int(truth), (time.perf_counter() - start) * 1000))
    df = db.spark.createDataFrame(rows, "estimator string, query_no int, estimated_cardinality long, true_cardinality long, elapsed_time_ms double")
    return df.withColumn("q_err", q_error(F.col("estimated_cardinality"), F.col("true_cardinality"))).select(*[c.split()[0] for c in RESULT.split(", ")])


def summary(results: DataFrame) -> DataFrame:
    """quantile, value of the q-errors."""
    return nearest_quantiles(results, "q_err")


def evaluate_together(db: Database, estimator: str, estimates: Callable[[list[str]], DataFrame], benchmark: Iterable[tuple[int, str]]) -> DataFrame:
    """As ``evaluate``, for an estimator that answers all queries in one job ((query_no, estimate)); the time is shared evenly."""
    asked = list(benchmark)
    if not asked:
        return db.spark.createDataFrame([], RESULT)
    start = time.perf_counter()
    found = db.spark.createDataFrame(estimates([sql for _, sql in asked]).collect(), "query_no int, estimate long")  # a row a query
    each = 1000 * (time.perf_counter() - start) / max(1, len(asked))
    truth = db.spark.createDataFrame([(k, int(t)) for k, (t, _) in enumerate(asked)], "query_no int, true_cardinality long")
    rows = found.join(F.broadcast(truth), "query_no").select(F.lit(estimator).alias("estimator"), "query_no", F.col("estimate").alias("estimated_cardinality"), "true_cardinality", F.lit(each).alias("elapsed_time_ms"))
    return rows.withColumn("q_err", q_error(F.col("estimated_cardinality"), F.col("true_cardinality"))).select(*[c.split()[0] for c in RESULT.split(", ")])


def evaluate_epochs(db: Database, load: Callable[[int], object], epochs: Iterable[int], benchmark: Iterable[tuple[int, str]]) -> DataFrame:
    """Results of every kept epoch of a stored model (``load`` gives its estimator), with the number in a column epoch."""
    asked, out = list(benchmark), None
    for e in sorted(epochs):
        one = evaluate_together(db, f"epoch {e}", load(e).estimates, asked).withColumn("epoch", F.lit(int(e)))
        out = one if out is None else out.unionAll(one)
    return out


class Estimator:
    """What the estimators have in common: a name, a way to answer a query, and errors and times that add up over runs."""

    def __init__(self, label: str, estimate: Estimate) -> None:
        self.label, self.estimate = label, estimate
        self.rows: list[tuple] = []

    def query(self, sql: str, truth: int) -> int:
        start = time.perf_counter()
        found = int(self.estimate(sql).first()[0])
        self.rows.append((self.label, len(self.rows), found, int(truth), (time.perf_counter() - start) * 1000))
        return found

    def get_stats(self) -> list[tuple]:
        return list(self.rows)

    def merge_stats(self, stats: Iterable[tuple]) -> Estimator:
        self.rows += [(x[0], len(self.rows) + k, *x[2:]) for k, x in enumerate(stats)]
        return self

    def results(self, spark: SparkSession) -> DataFrame:
        df = spark.createDataFrame(self.rows, "estimator string, query_no int, estimated_cardinality long, true_cardinality long, elapsed_time_ms double")
        return df.withColumn("q_err", q_error(F.col("estimated_cardinality"), F.col("true_cardinality")))

    def report(self, spark: SparkSession) -> DataFrame:
        """max, quantiles and mean of the errors, and the mean time."""
        return report(self.results(spark), "q_err", "elapsed_time_ms")


# ---- sub-queries and join orders -------------------------------------------------------------------------------------

Order = str | tuple  # a table, or a pair of orders


@dataclass(frozen=True)
class Plan:
    order: Order
    cost: float
    rows: float


def connected_subsets(b: Bound) -> list[tuple[frozenset[str], tuple[FkDef, ...]]]:
    """Sets of the query's tables that its edges hold together, by size, then name."""
    out = []
    for k in range(1, len(b.tables) + 1):
        for chosen in combinations(sorted(b.tables), k):
            edges = tuple(e for e in b.edges if e.parent in chosen and e.child in chosen)
            if is_tree(chosen, edges):
                out.append((frozenset(chosen), edges))
    return out


def true_cardinalities(db: Database, query: str) -> DataFrame:
    """(tables, cnt) of every connected sub-query, counted from sums by key; one union, so Spark runs them together."""
    b = db.bind(query)
    from ..operators.statistics import count_by_messages

    parts = []
    for chosen, edges in connected_subsets(b):
        names = sorted(chosen)
        tables = {t: db.filtered(t, b.predicates) for t in names}
        parts.append(count_by_messages(tables, edges, names[0]).select(F.lit(",".join(names)).alias("tables"), "cnt"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def best_order(b: Bound, rows: dict[frozenset[str], float]) -> Plan:
    """Cheapest join tree without cross joins, by dynamic programming; a plan costs the rows of all its joins together."""
    best: dict[frozenset[str], Plan] = {}
    for chosen, _ in connected_subsets(b):
        if len(chosen) == 1:
            (t,) = chosen
            best[chosen] = Plan(t, 0.0, rows[chosen])
            continue
        found = None
        names = sorted(chosen)
        for k in range(1, len(names)):
            for left in map(frozenset, combinations(names, k)):
                right = chosen - left
                if names[0] in left and left in best and right in best:
                    cost = best[left].cost + best[right].cost + rows[chosen]
                    if found is None or cost < found.cost:
                        found = Plan((best[left].order, best[right].order), cost, rows[chosen])
        best[chosen] = found
    return best[frozenset(b.tables)]


def cost_of(order: Order, rows: dict[frozenset[str], float]) -> tuple[frozenset[str], float]:
    """Tables of a join tree, and its cost under ``rows``."""
    if isinstance(order, str):
        return frozenset([order]), 0.0
    (a, x), (c, y) = (cost_of(o, rows) for o in order)
    return a | c, x + y + rows[a | c]


def order_text(order: Order) -> str:
    return order if isinstance(order, str) else f"({' '.join(map(order_text, order))})"


def plan_cost_error(db: Database, query: str, estimated: dict[frozenset[str], float], truth: dict[frozenset[str], float] | None = None) -> tuple:
    """(p_err, cost under estimates, cost under truth, both join orders): true cost of the plan chosen by estimates over
    the true cost of the best plan. A best cost of 0 gives 1 where the other is 0 too, else the other's cost."""
    b = db.bind(query)
    if truth is None:
        truth = {frozenset(r.tables.split(",")): float(r.cnt) for r in true_cardinalities(db, query).collect()}
    guess, ideal = best_order(b, estimated), best_order(b, truth)
    real = cost_of(guess.order, truth)[1]
    error = real / ideal.cost if ideal.cost else max(1.0, real)
    return error, real, ideal.cost, f"Leading{order_text(guess.order)}", f"Leading{order_text(ideal.order)}"


def plan_cost_errors(db: Database, queries: Iterable[str], estimate: Callable[[Bound, frozenset[str], tuple[FkDef, ...]], float]) -> DataFrame:
    """One row a query: query_no, p_err, cost_estcard, cost_truecard, join_order_estcard, join_order_truecard."""
    rows = []
    for k, sql in enumerate(queries):
        b = db.bind(sql)
        guessed = {chosen: float(estimate(b, chosen, edges)) for chosen, edges in connected_subsets(b)}
        rows.append((k, *plan_cost_error(db, sql, guessed)))
    return db.spark.createDataFrame(rows, "query_no int, p_err double, cost_estcard double, cost_truecard double, join_order_estcard string, join_order_truecard string")


def plan_cost_errors_of(db: Database, cards: DataFrame, queries: dict[str, str] | None = None) -> DataFrame:
    """Plan-cost errors from sub-query cardinalities: ``cards`` has name (the query's), node (its tables, joined by commas),
    estimate and true_cardinality, and sql where ``queries`` (by name) is not given: then the sql of the largest node is the query's.

    One row a query in the order of their names as numbers where they are numbers: query_no, p_err, costs and join orders.
    A benchmark is a list of queries with some hundreds of sub-queries; the frame is collected.
    """
    by: dict[str, dict[frozenset[str], tuple[float, float]]] = {}
    asked = dict(queries or {})
    widest: dict[str, int] = {}
    for r in cards.collect():
        tables = frozenset(x.strip() for x in r.node.split(","))
        by.setdefault(r["name"], {})[tables] = float(r.estimate), float(r.true_cardinality)
        if queries is None and len(tables) > widest.get(r["name"], 0):
            widest[r["name"]], asked[r["name"]] = len(tables), r.sql
    rows = []
    for k in sorted(by, key=natural):
        guess, truth = ({t: x[i] for t, x in by[k].items()} for i in (0, 1))
        rows.append((k, *plan_cost_error(db, asked[k], guess, truth)))
    return db.spark.createDataFrame(rows, "query_no string, p_err double, cost_estcard double, cost_truecard double, join_order_estcard string, join_order_truecard string")


def natural(text: str) -> tuple:
    """A sort key under which 2 comes before 10, also inside names such as epoch-10.pt."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.split(r"(\d+)", text) if x)

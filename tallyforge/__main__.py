"""Command line: train density models over a dataset, or evaluate estimators on a benchmark file."""

from __future__ import annotations

import argparse
import itertools
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models.density import Config
from .operators.sampling import sample_size
from .operators.statistics import reachable_size
from .plans.database import Database
from .plans.estimators import ORDERS, neighbourhood_exact, neighbourhood_sampled, universal_exact, universal_sampled
from .plans.evaluation import evaluate, evaluate_epochs, evaluate_together, plan_cost_errors_of, summary
from .plans.learned import Learned, LearnedNeighbourhoods, LearnedUniversal, epochs_of
from .sources.loaders import read_benchmark, read_subqueries, read_tables, write_results
from .sources.schemas import CYCLE, SCHEMAS, schema
from .sources.stages import Stages


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    # Names and defaults of options that users of such tools know.
    p.add_argument("--train", action="store_true", help="train density models, and store them in the folder --model")
    p.add_argument("--eval", action="store_true", help="evaluate on a benchmark: the model in --model, or else join samples")
    p.add_argument("--local", action="store_true", help="run Spark in this process")
    p.add_argument("-d", "--dataset", default="testdata", choices=sorted(SCHEMAS))
    p.add_argument("--data-dir", required=True, help="folder with one file or folder a table")
    p.add_argument("-s", "--schema-strategy", default="cin", choices=["cin", "ur"])
    p.add_argument("-t", "--model-type", default="mlp", choices=["mlp", "trm"])
    p.add_argument("-m", "--model", help="folder of a trained model")
    p.add_argument("-b", "--benchmark", help="CSV with true_cardinality and sql; with name and node too, plan-cost errors are taken")
    p.add_argument("--exact", action="store_true", help="evaluate the exact form of the estimator")
    p.add_argument("--out", help="folder for the result CSV, the settings and sub-query estimates")
    p.add_argument("--params-dir", help="folder of stages that are computed once")
    p.add_argument("--n-trials", type=int, help="choose among so many configurations")
    p.add_argument("--lr", type=float)
    p.add_argument("--warmups", type=int)
    p.add_argument("--n-blocks", type=int, default=2)
    p.add_argument("--n-heads", type=int, default=4)
    p.add_argument("--d-word", type=int, default=32)
    p.add_argument("--d-ff", type=int, default=64)
    p.add_argument("--n-ff", type=int, default=2)
    p.add_argument("-e", "--epochs", type=int, default=10)
    p.add_argument("--batch-size", type=int, default=1024)
    p.add_argument("--fact-threshold", type=int, default=16, help="bits of a code from which it is sliced")
    p.add_argument("--join-sample-size-min", type=int, default=100_000)
    p.add_argument("--join-sample-size-max", type=int, default=500_000)
    p.add_argument("--eval-sample-size", type=int, default=1000)
    p.add_argument("--eval-order", default="prop-ratio", choices=ORDERS)
    p.add_argument("--eval-disable-skip-high-card-cols", action="store_true")
    p.add_argument("-A", "--eval-all-intermediate-models", action="store_true")
    p.add_argument("--cont-fanout", action="store_true", help="fanouts as numbers, not categories")
    p.add_argument("--dump-intermediates", action="store_true", help="store the model of every epoch")
    p.add_argument("--seed", type=int, default=1234)
    return p


def configurations(args: argparse.Namespace) -> list[Config]:
    """The one that the options name, or --n-trials of a grid around it."""
    lr = args.lr if args.lr is not None or args.warmups is not None else 2e-3
    one = Config([1], args.model_type, args.d_word, args.d_ff, args.n_ff, args.n_blocks, args.n_heads, lr=lr, warmups=args.warmups, epochs=args.epochs, batch=args.batch_size, seed=args.seed)
    if not args.n_trials:
        return [one]
    rates = [lr] if args.warmups else [lr, 5e-3, 1e-3, 3e-4, 1e-4]
    grid = itertools.product((args.d_word, 32, 64), (args.d_ff, 64, 128), (args.n_ff, 2, 3), rates)
    made = [Config([1], args.model_type, d, f, n, args.n_blocks, args.n_heads, lr=r, warmups=args.warmups, epochs=args.epochs, batch=args.batch_size, seed=args.seed) for d, f, n, r in grid]
    found = [one, *(c for k, c in enumerate(made) if c != one and c not in made[:k])]
    return found[:1] + found[1 :: max(1, (len(found) - 1) // max(1, args.n_trials - 1))][: args.n_trials - 1]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("tallyforge").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master("local[*]") if args.local else builder).getOrCreate()
    s = schema(args.dataset)
    db = Database(spark, s, read_tables(spark, args.data_dir, s))
    universal = s.universal([CYCLE] if args.dataset == "testdata" else []) if args.schema_strategy == "ur" else None
    subs = [universal] if universal else s.neighbourhoods()
    options = {"samples": args.eval_sample_size, "order": args.eval_order, "skip_wide": not args.eval_disable_skip_high_card_cols}
    kind = LearnedUniversal if universal else LearnedNeighbourhoods
    first = subs[0]
    size = int(reachable_size({t: db.tables[t] for t in first.tables}, first.edges, first.root).first()["size"])
    n = sample_size(size, args.join_sample_size_min, args.join_sample_size_max)
    stages = Stages(s, db.tables, args.params_dir, args.data_dir) if args.params_dir else None
    if args.train:
        if not args.model:
            sys.exit("--train needs --model")
        more = {"config": configurations(args), "threshold": args.fact_threshold, "seed": args.seed, "continuous": args.cont_fanout, "every_epoch": args.dump_intermediates, "stages": stages}
        model = kind.fit(db, universal, n, **more, **options) if universal else kind.fit(db, None, n, **more, **options)
        model.save(args.model)
        print(f"model written to {args.model}")
    if args.eval:
        if not args.benchmark:
            sys.exit("--eval needs --benchmark")
        results = _evaluate(args, db, kind, subs, n, options)
        if args.out:
            spark.createDataFrame([(json.dumps(vars(args)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.out}/params")
            write_results(results, f"{args.out}/results")
    return 0


def _evaluate(args: argparse.Namespace, db: Database, kind: type[Learned], subs: list, n: int, options: dict) -> DataFrame:
    spark = db.spark

    def load(epoch: int | None = None) -> Learned:
        return kind.load(db, args.model, subs, epoch, seed=args.seed, **options)

    asked = read_benchmark(spark, args.benchmark)
    rows = [(r.true_cardinality, r.sql) for r in asked.collect()]
    if args.model and args.eval_all_intermediate_models:
        results = evaluate_epochs(db, load, epochs_of(db, args.model), rows)
    elif args.model:
        results = evaluate_together(db, args.schema_strategy, load().estimates, rows)
    elif args.schema_strategy == "ur":
        results = evaluate(db, "ur", lambda q: universal_exact(db, subs[0], q) if args.exact else universal_sampled(db, subs[0], q, n=n, seed=args.seed), rows)
    else:
        results = evaluate(db, "cin", lambda q: neighbourhood_exact(db, q) if args.exact else neighbourhood_sampled(db, q, n=n, seed=args.seed), rows)
    results = results.orderBy("query_no")
    results.show(len(rows), truncate=False)
    summary(results).orderBy("quantile").show()
    if {"name", "node"} <= set(asked.columns):
        cards = read_subqueries(spark, args.benchmark).collect()
        found = {r.query_no: int(r.estimated_cardinality) for r in results.collect()}
        frame = spark.createDataFrame([(*r, found[k]) for k, r in enumerate(cards)], "name string, node string, true_cardinality long, sql string, estimate long")
        errors = plan_cost_errors_of(db, frame)
        errors.show(truncate=False)
        summary(errors.withColumn("q_err", F.col("p_err"))).orderBy("quantile").show()
        if args.out:
            frame.select("name", "node", "estimate").coalesce(1).write.mode("overwrite").json(f"{args.out}/estimates")
            write_results(errors, f"{args.out}/plan_costs")
    return results


if __name__ == "__main__":
    sys.exit(main())

"""Estimates from density models trained on encoded join samples.

A query becomes a program: a list of steps that any block of samples runs on its own. Programs of many queries run in one
Spark job, a row for each query and block; only models (bounded by their configuration) and programs are sent out.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.predicates import Predicate, condition, normalize
from ..models.density import Config, Model, train, walk
from ..operators.graph import SubSchema
from ..operators.sampling import sample_join
from ..operators.statistics import away, dictionary, encode, name, reachable_size, with_adjacent_fanouts
from ..shipping import ship
from ..sources.stages import Stages
from .database import Database
from .estimators import boundary, neighbourhood_plan, ordered

BLOCK = 250  # samples a task's step holds


@dataclass
class Encoded:
    """Columns of a model: their dictionaries, bit slices and the model's column for each slice."""

    columns: list[str]
    dictionaries: dict[str, DataFrame]
    slices: dict[str, list[codes.Slice]]
    sizes: dict[str, int]  # codes a column has
    values: dict[str, np.ndarray]  # of fanout columns: value by code
    markers: dict[str, int]  # code of true by table
    index: dict[tuple[str, int], int]
    domains: list[int]
    continuous: list[str] = field(default_factory=list)  # fanout columns kept as the log of their value

    def place(self, column: str) -> list[tuple[int, int]]:
        """The model's column and the bit offset of every slice; offset -1: the code as it is."""
        slices = self.slices[column]
        return [(self.index[column, 0], -1)] if len(slices) == 1 else [(self.index[column, s.index], s.offset) for s in slices]

    def meta(self) -> dict:
        return {
            "columns": self.columns, "slices": {c: [[s.index, s.offset, s.width] for s in x] for c, x in self.slices.items()}, "sizes": self.sizes,
            "values": {c: v.tolist() for c, v in self.values.items()}, "markers": self.markers, "index": [[c, s, k] for (c, s), k in self.index.items()],
            "domains": self.domains, "continuous": self.continuous,
        }

    @classmethod
    def of(cls, meta: dict, dictionaries: dict[str, DataFrame]) -> Encoded:
        return cls(
            meta["columns"], dictionaries, {c: [codes.Slice(*s) for s in x] for c, x in meta["slices"].items()}, meta["sizes"],
            {c: np.array(v) for c, v in meta["values"].items()}, meta["markers"], {(c, s): k for c, s, k in meta["index"]}, meta["domains"], meta["continuous"],
        )


def sample_with_scales(db: Database, sub: SubSchema, n: int, seed: int) -> DataFrame:
    """A join sample with the away weight of every edge seen from both its ends."""
    df = sample_join({t: db.tables[t] for t in sub.tables}, sub.edges, sub.root, n, seed)
    df = df.select(*[name(c) for c in df.columns if "_fanout__" not in c])
    for k, (e, t) in enumerate([(e, t) for e in sub.edges for t in (e.parent, e.child)]):
        w = away({x: db.tables[x] for x in sub.tables}, sub.edges, e, t).select(F.col("key").alias(f"_k{k}"), F.col("w").cast("long").alias(f"__away__:{t}:{e.condition}"))
        df = df.join(w, name(f"{t}.{e.column_of(t)}") == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        df = df.withColumn(f"__away__:{t}:{e.condition}", F.coalesce(name(f"__away__:{t}:{e.condition}"), F.lit(1).cast("long")))
    return df


def encoded(db: Database, sample: DataFrame, skip: set[str], threshold: int, continuous: bool = False, stages: Stages | None = None) -> tuple[Encoded, DataFrame]:
    """Codes of the sample's columns, sliced where a domain exceeds 2 ** threshold. Base columns take the base table's
    dictionary, so a value that was not sampled still has a code; ``skip``: key columns, which queries don't ask for.
    continuous: fanouts are the log of their value, not categories."""
    columns = [c for c in sample.columns if c not in skip and c != "sample"]
    enc = Encoded(columns, {}, {}, {}, {}, {}, {}, [])
    df = sample
    numbers = [c for c in columns if continuous and (c.startswith("__away__") or "_fanout__" in c)]
    for c in columns:
        if c in numbers:
            enc.slices[c], enc.sizes[c] = [codes.Slice(0, 0, 1)], 1
            enc.index[c, 0] = len(enc.domains)
            enc.domains.append(1)
            enc.continuous.append(c)
            df = df.withColumn(f"__code__:{c}", codes.log_fanout(name(c)))
            continue
        table, _, column = c.partition(".")
        own = c.startswith("__") or "fanout__" in c
        found = dictionary(sample, c) if own else stages.dictionary(table, column) if stages else dictionary(db.tables[table], column).persist()
        if own:
            found = db.spark.createDataFrame(found.collect(), found.schema)  # distinct fanouts and markers of a sample
        enc.dictionaries[c] = found
        enc.sizes[c] = found.count() + codes.FIRST
        enc.slices[c] = codes.factorize(enc.sizes[c], threshold)
        if c.startswith("__in__:"):
            true = found.where("value").first()
            enc.markers[c.removeprefix("__in__:")] = int(true.code) if true else codes.MASK
        if c.startswith("__away__") or "_fanout__" in c:
            enc.values[c] = np.array([1.0, 1.0, *(float(r.value) for r in found.orderBy("code").collect())])
        df = encode(df, c, found, f"__code__:{c}")
        for s in enc.slices[c]:
            enc.index[c, s.index] = len(enc.domains)
            enc.domains.append(enc.sizes[c] if len(enc.slices[c]) == 1 else s.size)
    parts = []
    for c in columns:
        code = name(f"__code__:{c}")
        for s in enc.slices[c]:
            part = code if c in numbers else (code if len(enc.slices[c]) == 1 else codes.slice_code(code, s)).cast("int")
            parts.append(part.alias(f"c{enc.index[c, s.index]}"))
    return enc, df.select(*parts)


# ---- masks -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SliceMask:
    """Which values of a slice some allowed code has, given each sample's higher slices. Codes beyond the domain have none."""

    above: tuple[tuple[int, int], ...]  # model columns of higher slices, and their offsets
    offset: int
    width: int
    domain: int
    allowed: np.ndarray

    def __call__(self, seen: np.ndarray) -> np.ndarray:
        high = np.zeros(len(seen), np.int64)
        for k, offset in self.above:
            high |= (seen[:, k].astype(np.int64) - 1) << offset
        ok = np.zeros((len(seen), self.domain))
        part = ((self.allowed >> self.offset) & ((1 << self.width) - 1)) + 1
        top = self.allowed >> (self.offset + self.width) << (self.offset + self.width)  # ascending, as the codes are
        for prefix in np.unique(high):
            lo, hi = np.searchsorted(top, [prefix, prefix + 1])
            ok[np.ix_(high == prefix, np.unique(part[lo:hi]))] = 1
        return ok


def bit_masks(enc: Encoded, column: str, allowed: np.ndarray) -> list[tuple[int, object]]:
    """Masks over a column's slices, from the high bits on; a lower slice's mask follows each sample's higher bits."""
    slices, domains = enc.slices[column], enc.domains
    if column in enc.continuous:
        return [(enc.index[column, 0], None)]
    if len(slices) == 1:
        k = enc.index[column, 0]
        mask = np.zeros(domains[k])
        mask[allowed] = 1
        return [(k, mask)]
    allowed = np.sort(allowed)
    out = []
    for s in reversed(slices):
        above = tuple((enc.index[column, t.index], t.offset) for t in slices if t.index > s.index)
        out.append((enc.index[column, s.index], SliceMask(above, s.offset, s.width, domains[enc.index[column, s.index]], allowed)))
    return out


def matching_codes(found: DataFrame, predicates: list[Predicate]) -> np.ndarray:
    """Codes of a dictionary that meet all predicates of its column, ascending. Ranges of values are ranges of codes; else
    the codes come as bits, a row for each 64 of them at most."""
    ok = F.lit(True)
    nulls = all(p.op == "ALL_TRUE" or (p.op == "IS" and p.value is None) or (p.op == "IS NOT" and p.value is not None) for p in predicates)
    for p in predicates:
        ok = ok & F.coalesce(condition(p, F.col("value")), F.lit(False))
    hits = found.where(ok)
    if all(p.op in (">", "<", ">=", "<=", "=") for p in predicates):
        lo, hi = hits.agg(F.min("code"), F.max("code")).first()
        out = np.arange(lo, hi + 1) if lo is not None else np.zeros(0, np.int64)
    else:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("code").bitwiseAND(F.lit(63)).cast("int"))
        words = hits.groupBy(F.shiftright("code", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
        parts = [np.flatnonzero(np.unpackbits(np.array([r.bits], "<i8").view(np.uint8), bitorder="little")) + 64 * r.word for r in words]
        out = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return np.r_[codes.NULL, out] if nulls else out


def conditions(enc: Encoded, tables: tuple[str, ...], predicates: list[Predicate], order: str = "prop-ratio") -> list[tuple[int, object]]:
    """Steps that fix the tables' markers, then the predicates' columns in ``order`` (see ``estimators.ordered``)."""
    steps: list[tuple[int, object]] = []
    for t in tables:
        steps += bit_masks(enc, f"__in__:{t}", np.array([enc.markers[t]] if enc.markers[t] else [], np.int64))
    by: dict[str, list[Predicate]] = {}
    for p in predicates:
        by.setdefault(p.name, []).append(p)
    for c in by:
        if c not in enc.columns:
            raise ValueError(f"the model has no column {c}")
    allowed = {c: matching_codes(enc.dictionaries[c], ps) for c, ps in by.items()}
    for c in ordered({c: (len(a), enc.sizes[c]) for c, a in allowed.items()}, order, enc.columns):
        steps += bit_masks(enc, c, allowed[c])
    return steps


def anything(enc: Encoded, column: str, first: int = codes.NULL) -> list[tuple[int, object]]:
    """Steps that draw a column freely, NULL included from ``first`` 1 on."""
    return bit_masks(enc, column, np.arange(first, enc.sizes[column]))


# ---- programs --------------------------------------------------------------------------------------------------------

Step = tuple  # kind, model, arguments


def code_of(place: list[tuple[int, int]], drawn: np.ndarray) -> np.ndarray:
    """Codes of a column that all samples have drawn."""
    if place[0][1] < 0:
        return drawn[:, place[0][0]].astype(np.int64)
    out = np.zeros(len(drawn), np.int64)
    for k, offset in place:
        out |= (drawn[:, k].astype(np.int64) - 1) << offset
    return out


def run_program(models: dict[str, Model], program: list[Step], samples: int, rng: np.random.Generator) -> np.ndarray:
    """Each sample's product. walk: multiply by the chance of the steps; free: draw a column that is not known yet; scale:
    multiply by a fanout to a power; copy: hand codes from one model's samples to another's; know: set a column."""
    p = np.ones(samples)
    state = {k: np.zeros((samples, len(m.config.domains)), np.float64 if m.config.continuous else np.int64) for k, m in models.items()}
    for kind, of, *rest in program:
        drawn = state[of]
        if kind == "walk":
            p *= walk(models[of], drawn, rest[0], rng)
        elif kind == "free":
            if not (drawn[:, rest[0][0][0]] != 0).all():
                walk(models[of], drawn, rest[0], rng)
        elif kind == "scale":
            place, values, power = rest
            if values is None:  # the log of the fanout
                p *= np.maximum(2.0 ** drawn[:, place[0][0]], 1) ** power
            else:
                p *= values[np.minimum(code_of(place, drawn), len(values) - 1)] ** power
        elif kind == "copy":
            source, pairs = rest
            for i, j in pairs:
                drawn[:, j] = state[source][:, i]
        else:
            drawn[:, rest[0]] = rest[1]
    return p


def run_programs(db: Database, models: dict[str, Model], programs: list[tuple[float, list[Step]]], samples: int, seed: int) -> DataFrame:
    """(query_no, estimate) of programs (factor, steps): ceil of the factor times the mean over samples, one job for all."""
    spark = db.spark
    ship(spark)
    sent = spark.sparkContext.broadcast((models, [p for _, p in programs]))
    blocks = max(1, -(-samples // BLOCK))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, asked = sent.value
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                q, b = divmod(int(i), blocks)
                n = min(BLOCK, samples - b * BLOCK)
                used = {of for _, of, *_ in asked[q]}
                rows.append((q, float(run_program({k: held[k] for k in used}, asked[q], n, np.random.default_rng([seed, q, b])).sum())))
            yield pd.DataFrame(rows, columns=["query_no", "total"])

    todo = len(programs) * blocks
    found = spark.range(0, todo, 1, max(1, min(todo, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(run, "query_no int, total double")
    factors = F.broadcast(spark.createDataFrame([(k, float(f)) for k, (f, _) in enumerate(programs)], "query_no int, factor double"))  # a row a query
    sums = found.groupBy("query_no").agg(F.sum("total").alias("total")).join(factors, "query_no")
    return sums.select("query_no", F.ceil(F.round(F.col("factor") * F.col("total") / samples, 6)).cast("long").alias("estimate"))


# ---- training --------------------------------------------------------------------------------------------------------


def train_on_executors(parts: dict[str, DataFrame], configs: dict[str, list[Config]], every_epoch: bool = False) -> DataFrame:
    """(model, trial, epoch, loss, weights) of every sample in ``parts`` under each of its configurations, a task for each.

    Samples are bounded (100,000 to 500,000 rows of small codes), so one task holds one. Only the last epoch's row is
    kept unless ``every_epoch``.
    """
    spark = next(iter(parts.values())).sparkSession
    ship(spark)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        config = configs[key[0]][key[1]]
        x = np.array(pdf["row"].to_list(), np.float64).reshape(-1, len(config.domains))
        rows: list[tuple] = []

        def told(epoch: int, model: Model, loss: float) -> None:
            if not every_epoch:
                rows.clear()
            rows.append((*key, epoch, loss, pickle.dumps(model)))

        model, _ = train(x if config.continuous else x.astype(np.int64), config, told)
        if not rows:
            rows.append((*key, 0, float("nan"), pickle.dumps(model)))
        return pd.DataFrame(rows, columns=["model", "trial", "epoch", "loss", "weights"])

    every = None
    for k, df in parts.items():
        row = F.array(*[F.col(f"c{i}").cast("double") for i in range(len(df.columns))])
        one = df.select(F.lit(k).alias("model"), F.explode(F.array(*[F.lit(t) for t in range(len(configs[k]))])).alias("trial"), row.alias("row"))
        every = one if every is None else every.unionAll(one)
    return every.groupBy("model", "trial").applyInPandas(run, "model string, trial int, epoch int, loss double, weights binary")


def best_models(parts: dict[str, DataFrame], configs: dict[str, list[Config]], every_epoch: bool = False, reduction: int = 2) -> dict[str, list[tuple[int, float, Model]]]:
    """For each sample the epochs (number, loss, model) of its best configuration, by successive halving where there are
    several: every round the better half trains ``reduction`` times as long."""
    left = {k: list(c) for k, c in configs.items()}
    many = max(len(c) for c in left.values())
    whole = max(c.epochs for x in left.values() for c in x)
    epochs = max(whole // reduction ** max(0, (many - 1).bit_length()), 1) if many > 1 else whole
    parts = {k: df.persist() for k, df in parts.items()}
    try:
        while True:
            last = epochs >= whole
            now = {k: [replace(c, epochs=min(epochs, c.epochs)) for c in x] for k, x in left.items()}
            rows = train_on_executors(parts, now, every_epoch and last).collect()
            by: dict[str, dict[int, list]] = {}
            for r in sorted(rows, key=lambda r: r.epoch):
                by.setdefault(r.model, {}).setdefault(r.trial, []).append(r)
            ranked = {k: sorted(t, key=lambda i, t=t: (np.nan_to_num(t[i][-1].loss, nan=np.inf), i)) for k, t in by.items()}
            if last:
                return {k: [(r.epoch, float(r.loss), pickle.loads(bytes(r.weights))) for r in by[k][order[0]]] for k, order in ranked.items()}  # noqa: S301
            left = {k: [left[k][i] for i in order[: max(1, len(order) // reduction)]] for k, order in ranked.items()}
            epochs = min(whole, epochs * reduction)
    finally:
        for df in parts.values():
            df.unpersist()


def _write_json(db: Database, path: str, value: object) -> None:
    db.spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(db: Database, path: str) -> object:
    return json.loads(db.spark.read.text(path, wholetext=True).first().value)


def _save_part(db: Database, path: str, sub: SubSchema, size: int, enc: Encoded, epochs: list[tuple[int, float, Model]]) -> None:
    for k, c in enumerate(enc.columns):
        if c in enc.dictionaries:
            enc.dictionaries[c].write.mode("overwrite").parquet(f"{path}/dictionary/{k}")
    rows = [
        (epoch, loss, json.dumps(asdict(m.config)), key, list(v.shape), str(v.dtype), v.tobytes())
        for epoch, loss, m in epochs for key, v in m.params.items()
    ]
    db.spark.createDataFrame(rows, "epoch int, loss double, config string, param string, shape array<int>, dtype string, data binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    _write_json(db, f"{path}/meta", {"sub": sub.name, "size": size, "encoded": enc.meta(), "epochs": [[e, x] for e, x, _ in epochs]})


def _load_part(db: Database, path: str, epoch: int | None) -> tuple[str, int, Encoded, list[tuple[int, float, Model]]]:
    """epoch: that one, or the last."""
    meta = _read_json(db, f"{path}/meta")
    enc_meta = meta["encoded"]
    dictionaries = {c: db.spark.read.parquet(f"{path}/dictionary/{k}") for k, c in enumerate(enc_meta["columns"]) if c not in enc_meta["continuous"]}
    epoch = max(e for e, _ in meta["epochs"]) if epoch is None else epoch
    rows = db.spark.read.parquet(f"{path}/weights").where(F.col("epoch") == epoch).collect()
    if not rows:
        raise ValueError(f"no epoch {epoch} in {path}")
    params = {r.param: np.frombuffer(bytes(r.data), r.dtype).reshape(r["shape"]).copy() for r in rows}
    return meta["sub"], int(meta["size"]), Encoded.of(enc_meta, dictionaries), [(epoch, rows[0].loss, Model(Config(**json.loads(rows[0].config)), params))]


def epochs_of(db: Database, path: str) -> list[int]:
    """Numbers of the epochs whose models are stored, ascending as numbers."""
    parts = _read_json(db, f"{path}/index")["parts"]
    return sorted(set.intersection(*[{int(e) for e, _ in _read_json(db, f"{path}/{k}/meta")["epochs"]} for k in range(len(parts))]))


class Learned:
    """What both learned estimators share: storing, loading, and answering many queries in one job."""

    kind = ""

    def __init__(self, db: Database, parts: dict[str, tuple[SubSchema, int, Encoded, list[tuple[int, float, Model]]]], samples: int = 1000, seed: int = 1234, order: str = "prop-ratio", skip_wide: bool = True) -> None:
        self.db, self.parts, self.samples, self.seed, self.order, self.skip_wide = db, parts, samples, seed, order, skip_wide

    def save(self, path: str) -> None:
        """A folder with the dictionaries, slices, sizes and the weights of every kept epoch, through Spark's writers."""
        for k, (sub, size, enc, epochs) in enumerate(self.parts.values()):
            _save_part(self.db, f"{path}/{k}", sub, size, enc, epochs)
        _write_json(self.db, f"{path}/index", {"kind": self.kind, "parts": list(self.parts)})

    @classmethod
    def load(cls, db: Database, path: str, subs: Iterable[SubSchema], epoch: int | None = None, **options: object) -> Learned:
        """subs: the partitions a stored model may cover; epoch: one that was kept, by default the last."""
        index = _read_json(db, f"{path}/index")
        if index["kind"] != cls.kind:
            raise ValueError(f"{path} holds a model of kind {index['kind']}")
        by = {s.name: s for s in subs}
        parts = {}
        for k in range(len(index["parts"])):
            sub, size, enc, epochs = _load_part(db, f"{path}/{k}", epoch)
            if sub not in by:
                raise ValueError(f"the schema has no partition {sub}")
            parts[sub] = by[sub], size, enc, epochs
        return cls(db, parts, **options)

    @property
    def models(self) -> dict[str, Model]:
        return {k: epochs[-1][2] for k, (_, _, _, epochs) in self.parts.items()}

    def program(self, query: str) -> tuple[float, list[Step]]:
        raise NotImplementedError

    def estimates(self, queries: Iterable[str]) -> DataFrame:
        """(query_no, estimate) of all queries, in one job."""
        return run_programs(self.db, self.models, [self.program(q) for q in queries], self.samples, self.seed)

    def estimate(self, query: str) -> DataFrame:
        """One row: estimate."""
        return self.estimates([query]).select("estimate")


class LearnedUniversal(Learned):
    """card = size of the relation times the mean over samples of P(predicates and used tables) / scales of unused edges."""

    kind = "ur"

    @classmethod
    def fit(
        cls, db: Database, sub: SubSchema, n: int = 100_000, config: Config | list[Config] | None = None, threshold: int = 16, seed: int = 1234, columns: set[str] | None = None,
        continuous: bool = False, every_epoch: bool = False, stages: Stages | None = None, **options: object,
    ) -> LearnedUniversal:
        """columns: base columns (``table.column``) the model covers; by default all but keys. config: one, or several to choose from."""
        keys = {f"{e.parent}.{e.pk}" for e in sub.edges} | {f"{e.child}.{e.fk}" for e in sub.edges}
        make = lambda: sample_with_scales(db, sub, n, seed)
        sample = stages.sample(sub, n, seed, make, "scales") if stages else make().persist()
        skip = keys if columns is None else {c for c in sample.columns if "." in c and not c.startswith("__") and c not in columns}
        enc, rows = encoded(db, sample, skip, threshold, continuous, stages)
        if stages:
            rows = stages.discretized(sub, lambda: rows, threshold=threshold, n=n, seed=seed, form=f"scales {continuous} {sorted(skip)}")
        size = reachable_size(db.tables, sub.edges, sub.root).first()["size"]
        found = best_models({sub.name: rows}, {sub.name: _configs(config, enc, seed)}, every_epoch)
        return cls(db, {sub.name: (sub, int(size), enc, found[sub.name])}, seed=seed, **options)

    def program(self, query: str) -> tuple[float, list[Step]]:
        ((sub, size, enc, _),) = self.parts.values()
        b = self.db.bind(query)
        program: list[Step] = [("walk", sub.name, conditions(enc, b.tables, normalize(b.predicates), self.order))]
        for e, t in boundary(sub.edges, b.tables):
            c = f"__away__:{t}:{e.condition}"
            program += [("free", sub.name, anything(enc, c, codes.FIRST)), ("scale", sub.name, enc.place(c), enc.values.get(c), -1)]
        return float(size), program


def _configs(config: Config | list[Config] | None, enc: Encoded, seed: int) -> list[Config]:
    numbers = [enc.index[c, 0] for c in enc.continuous]
    if config is None:
        return [Config(enc.domains, seed=seed, continuous=numbers)]
    return [replace(c, domains=enc.domains, continuous=numbers) for c in (config if isinstance(config, list) else [config])]


class LearnedNeighbourhoods(Learned):
    """One model a neighbourhood, chained by common tables.

    The answer starts from the size of the plan's first neighbourhood and the chance that its predicates hold. For each
    further one, every sample draws the common table's columns that are still unknown and its fanout to the new center,
    multiplies by the fanout, and hands the common columns' codes on as conditions. skip_wide: columns with more values
    than half the neighbourhood's rows are not drawn for that.
    """

    kind = "cin"

    @classmethod
    def fit(
        cls, db: Database, names: list[str] | None = None, n: int = 100_000, config: Config | list[Config] | None = None, threshold: int = 16, seed: int = 1234, wide: bool = False,
        continuous: bool = False, every_epoch: bool = False, stages: Stages | None = None, **options: object,
    ) -> LearnedNeighbourhoods:
        """names: neighbourhoods to model; by default all. Keys are left out, and, unless ``wide``, columns with more values than half the sample."""
        made = {}
        for sub in db.schema.neighbourhoods():
            if names is not None and sub.name not in names:
                continue

            def make(sub: SubSchema = sub) -> DataFrame:
                tables = {t: with_adjacent_fanouts(t, db.tables, [e for e in db.schema.fks if e.parent == t]) for t in sub.tables}
                return sample_join(tables, sub.edges, sub.root, n, seed)

            sample = stages.sample(sub, n, seed, make, "adjacent") if stages else make().persist()
            sample = sample.select(*[name(c) for c in sample.columns if ".__fanout__" not in c])
            keys = {f"{t}.{c}" for e in db.schema.fks for t, c in ((e.parent, e.pk), (e.child, e.fk))}
            base = [c for c in sample.columns if not c.startswith("__") and "fanout__" not in c and c not in keys and c != "sample"]
            skip = set(keys)
            if base and not wide:
                counts = sample.agg(*[F.approx_count_distinct(name(c)).alias(f"n{k}") for k, c in enumerate(base)]).first()
                skip |= {c for k, c in enumerate(base) if counts[f"n{k}"] > n / 2}
            enc, rows = encoded(db, sample, skip, threshold, continuous, stages)
            if stages:
                rows = stages.discretized(sub, lambda rows=rows: rows, threshold=threshold, n=n, seed=seed, form=f"adjacent {continuous} {sorted(skip)}")
            size = reachable_size({t: db.tables[t] for t in sub.tables}, sub.edges, sub.root).first()["size"]
            made[sub.name] = sub, int(size), enc, rows
        found = best_models({k: rows for k, (_, _, _, rows) in made.items()}, {k: _configs(config, enc, seed) for k, (_, _, enc, _) in made.items()}, every_epoch)
        return cls(db, {k: (sub, size, enc, found[k]) for k, (sub, size, enc, _) in made.items()}, seed=seed, **options)

    def program(self, query: str) -> tuple[float, list[Step]]:
        b = self.db.bind(query)
        plan = neighbourhood_plan(self.db, b)
        for link in plan:
            if link.sub.name not in self.parts:
                raise ValueError(f"there is no model of {link.sub.name}")
        predicates = normalize(b.predicates)
        program: list[Step] = []
        done: set[str] = set()
        for k, link in enumerate(plan):
            at = link.sub.name
            _, _, enc, _ = self.parts[at]
            if k:
                before = next(x for x in plan[:k] if link.common in x.tables).sub.name
                _, rows, old, _ = self.parts[before]
                own = [c for c in old.columns if c.startswith(f"{link.common}.") and "fanout__" not in c and not (self.skip_wide and old.sizes[c] > max(rows / 2, codes.FIRST + 2))]
                program += [("free", before, anything(old, c)) for c in own]
                edge = link.edge or next(e for e in link.sub.edges if link.common in (e.parent, e.child))
                if edge.parent == link.common:
                    fan = f"{link.common}.__adj_fanout__:{edge.pk}={edge.child}.{edge.fk}"
                    program += [("free", before, anything(old, fan, codes.FIRST)), ("scale", before, old.place(fan), old.values.get(fan), 1)]
                shared = [c for c in own if c in enc.columns and len(enc.slices[c]) == len(old.slices[c])]  # the same dictionary, so the same codes
                program.append(("copy", at, before, [(old.index[c, s.index], enc.index[c, s.index]) for c in shared for s in enc.slices[c]]))
                program.append(("know", at, enc.index[f"__in__:{link.common}", 0], enc.markers[link.common]))
            fresh = tuple(t for t in link.tables if t in b.tables and t not in done)
            program.append(("walk", at, conditions(enc, fresh, [p for p in predicates if p.table in fresh], self.order)))
            if k == 0 and not b.edges and b.tables[0] != link.sub.center:
                e = next(e for e in link.sub.edges if e.parent == b.tables[0])
                fan = f"{e.parent}.__adj_fanout__:{e.pk}={e.child}.{e.fk}"
                program += [("free", at, anything(enc, fan, codes.FIRST)), ("scale", at, enc.place(fan), enc.values.get(fan), -1)]
            done |= set(fresh)
        return float(self.parts[plan[0].sub.name][1]), program

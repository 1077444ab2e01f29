"""Near-duplicates among embeddings by cosine, through randomised-rotation binary codes.

A vector is turned by a random rotation; its code is the signs of the result, and its correction factor the inner
product of the unit code with the turned vector. code(x) . y / factor(x) is then an unbiased estimate of x . y, with an
error of the order sqrt((1 - f^2) / f^2 / (D - 1)); y enters with four bits a component, whose rounding is bounded as
well. Candidates meet in tables keyed by sign bits of further random directions; only pairs whose upper confidence bound
reaches the threshold are computed exactly, from the vectors themselves.

Equal vectors are one class with a multiplicity. No pair leaves its bucket: buckets give link counts and a spanning
forest. Buckets above BLOCK rows are compared in pairs of blocks, each a task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import components, drop, parallelism, spread_join, stage, table

COSINE = 0.95
RECALL = 0.98  # wanted for pairs just at the threshold; closer ones are found more surely
BUCKET = 16  # vectors a bucket by chance
SIGMAS = 3.5  # half-width of the confidence interval of an estimate, in units of its error
BLOCK = 2048
ROWS_A_TASK = 200_000  # rows of buckets and of their blocks' copies
SEED = 20_001


def tables_for(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    bits = min(30, max(1, round(math.log2(max(2, n / BUCKET)))))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def directions(dim: int, count: int) -> np.ndarray:
    return np.concatenate([rotation(dim, SEED + 1 + k) for k in range(-(-count // dim))])[:count]


class Coder:
    """Codes, correction factors, four-bit components and table keys of unit vectors."""

    def __init__(self, dim: int, bits: int, tables: int) -> None:
        self.dim, self.bits, self.tables = dim, bits, tables
        self.turn = rotation(dim)
        self.planes = directions(dim, bits * tables)

    def __call__(self, x: np.ndarray) -> dict[str, np.ndarray]:
        turned = x @ self.turn.T
        signs = turned > 0
        factor = np.abs(turned).sum(1) / math.sqrt(self.dim)
        low = turned.min(1)
        step = np.maximum(turned.max(1) - low, 1e-12) / 15
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        levels = np.pad(levels, ((0, 0), (0, self.dim % 2)))
        weights = 1 << np.arange(self.bits, dtype=np.int64)
        keys = ((x @ self.planes.T > 0).reshape(len(x), self.tables, self.bits) * weights).sum(2).astype(np.int32)
        return {
            "code": np.packbits(signs, axis=1), "factor": factor.astype(np.float32), "low": low.astype(np.float32), "step": step.astype(np.float32),
            "levels": levels[:, ::2] << 4 | levels[:, 1::2], "keys": keys,
        }


def estimates(a: dict[str, np.ndarray], b: dict[str, np.ndarray], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of every a with every b (leading axes are batches), and the half-width of their intervals."""
    signs = np.unpackbits(a["code"], axis=-1, count=dim).astype(np.float32) * 2 - 1
    levels = np.stack([b["levels"] >> 4, b["levels"] & 15], -1).reshape(*b["levels"].shape[:-1], -1)[..., :dim].astype(np.float32)
    y = levels * b["step"][..., None] + b["low"][..., None]
    f = np.maximum(a["factor"], 1e-3)[..., None]
    found = signs @ np.swapaxes(y, -1, -2) / math.sqrt(dim) / f
    # A code's own error, and the rounding of y: uniform in half a step, independent over components.
    error = np.sqrt(np.maximum(1 - f * f, 0)) / f / math.sqrt(max(1, dim - 1))
    rounding = b["step"][..., None, :] / math.sqrt(12) / f
    return found, SIGMAS * np.sqrt(error**2 + rounding**2)


def unit_vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Doubles of length 1, shorter vectors padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        x = flat.reshape(-1, dim)
    else:
        x = np.zeros((len(sizes), dim))
        at = 0
        for k, n in enumerate(sizes):
            x[k, :n] = flat[at : at + n]
            at += n
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_CODED = "tab int, key int, node long, code binary, factor float, low float, step float, levels binary, keys binary"


def _encode(dim: int, bits: int, tables: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(dim, bits, tables)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                found = coder(unit_vectors(part.column(1), dim))
                n = part.num_rows
                node = part.column(0).to_numpy()

                def blobs(x: np.ndarray, n: int = n) -> list[bytes]:
                    return [r.tobytes() for r in np.ascontiguousarray(x).reshape(n, -1)]

                fixed = {"code": blobs(found["code"]), "levels": blobs(found["levels"]), "keys": blobs(found["keys"])}
                for t in range(tables):
                    yield pa.record_batch({
                        "tab": pa.array(np.full(n, t, np.int32)), "key": pa.array(found["keys"][:, t].copy()), "node": pa.array(node),
                        "code": pa.array(fixed["code"], pa.binary()), "factor": pa.array(found["factor"]), "low": pa.array(found["low"]),
                        "step": pa.array(found["step"]), "levels": pa.array(fixed["levels"], pa.binary()), "keys": pa.array(fixed["keys"], pa.binary()),
                    })

    return run


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts by the keys (the first leads), starts and lengths of runs of equal keys."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.r_[starts, len(order)])


def _first_meeting(x: np.ndarray, y: np.ndarray, t: int) -> np.ndarray:
    """Whether no table before t has both vectors in one bucket, for all pairs."""
    out = np.ones((*x.shape[:-1], y.shape[-2]), bool)
    for k in range(t):
        out &= x[..., :, None, k] != y[..., None, :, k]
    return out


def _all(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = list(batches)
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _column(found: pa.Table, name: str) -> np.ndarray:
    return found.column(name).to_numpy()


def _matrix(found: pa.Table, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(found.column(name).to_pylist()), dtype).reshape(found.num_rows, -1)


def _candidates(dim: int, cosine: float):  # noqa: ANN202
    """Rows of a bucket (or of two of its blocks) that have a candidate: a pair met first here whose bound reaches the threshold."""
    out = pa.schema([("tab", pa.int32()), ("key", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _all(batches)
        if found is None:
            return
        head = {c: _column(found, c) for c in ("tab", "key", "i", "j", "side", "node")}
        data = {"factor": _column(found, "factor"), "low": _column(found, "low"), "step": _column(found, "step"),
                "code": _matrix(found, "code", np.uint8), "levels": _matrix(found, "levels", np.uint8), "keys": _matrix(found, "keys", np.int32)}
        order, starts, lengths = _runs(head["tab"], head["key"], head["i"], head["j"], head["side"])
        active = np.zeros(len(order), bool)
        whole = head["i"][order[starts]] == head["j"][order[starts]]

        def mark(at: np.ndarray, to: np.ndarray, tabs: np.ndarray) -> None:
            """at, to: row numbers (groups, members)."""
            a = {c: v[at] for c, v in data.items()}
            b = a if at is to else {c: v[to] for c, v in data.items()}
            value, wide = estimates(a, b, dim)
            fits = value + wide >= cosine
            if at is to:
                fits &= np.triu(np.ones(fits.shape[1:], bool), 1)
            for t in np.unique(tabs):
                g = tabs == t
                if fits[g].any():
                    fits[g] &= _first_meeting(a["keys"][g], b["keys"][g], int(t))
            active[at[fits.any(2)]] = True
            active[to[fits.any(1)]] = True

        for m in np.unique(lengths[whole & (lengths > 1)]):
            rows = order[starts[whole & (lengths == m)][:, None] + np.arange(m)]
            for lo in range(0, len(rows), max(1, 400_000 // int(m * m))):
                part = rows[lo : lo + max(1, 400_000 // int(m * m))]
                mark(part, part, head["tab"][part[:, 0]])
        for k in np.flatnonzero(~whole):
            if head["side"][order[starts[k]]] == 0 and k + 1 < len(starts):
                a, b = order[starts[k] : starts[k] + lengths[k]], order[starts[k + 1] : starts[k + 1] + lengths[k + 1]]
                if all(head[c][a[0]] == head[c][b[0]] for c in ("tab", "key", "i", "j")):
                    mark(a[None], b[None], head["tab"][a[:1]])
        rows = np.flatnonzero(active)
        for lo in range(0, len(rows), 50_000):
            part = rows[lo : lo + 50_000]
            yield pa.record_batch([pa.array(head[f.name][part], f.type) for f in out], schema=out)

    return run


def _exact(dim: int, bits: int, tables: int, cosine: float):  # noqa: ANN202
    """Exact cosines of the rows that have candidates: links weighted by multiplicity, and each row's root in its bucket."""
    out = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _all(batches)
        if found is None:
            return
        head = {c: _column(found, c) for c in ("tab", "key", "i", "j", "side", "node", "copies")}
        x = unit_vectors(found.column("embedding"), dim)
        keys = Coder(dim, bits, tables)(x)["keys"]
        order, starts, lengths = _runs(head["tab"], head["key"], head["i"], head["j"])
        links = np.zeros(len(order), np.int64)
        root = head["node"].copy()
        for k in np.flatnonzero(lengths > 1):
            rows = order[starts[k] : starts[k] + lengths[k]]
            t = int(head["tab"][rows[0]])
            side = head["side"][rows]
            apart = head["i"][rows[0]] != head["j"][rows[0]]
            a, b = (rows[side == 0], rows[side == 1]) if apart else (rows, rows)
            near = x[a] @ x[b].T >= cosine
            if not apart:
                near &= ~np.eye(len(a), dtype=bool)
            near &= _first_meeting(keys[a], keys[b], t)
            links[a] += near @ head["copies"][b]
            if apart:
                links[b] += near.T @ head["copies"][a]
            # Breadth-first over the bucket: every row gets the least node its search started from.
            todo = np.ones(len(rows), bool)
            full = np.zeros((len(rows), len(rows)), bool) if apart else near
            if apart:
                ia, ib = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                full[np.ix_(ia, ib)] = near
                full[np.ix_(ib, ia)] = near.T
            for s in range(len(rows)):
                if not todo[s]:
                    continue
                front = np.zeros(len(rows), bool)
                front[s] = True
                todo[s] = False
                while front.any():
                    root[rows[front]] = head["node"][rows[s]]
                    front = full[front].any(0) & todo
                    todo &= ~front
        some = np.flatnonzero((links > 0) | (root != head["node"]))
        yield pa.record_batch([pa.array(head["node"][some]), pa.array(links[some]), pa.array(root[some])], schema=out)

    return run


def link_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id long, embedding array of numbers).

    Links need a cosine of at least ``cosine`` in double precision. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing; shorter vectors count as padded with zeros. Equal vectors are linked.
    A null vec_id is greater than all. Repeated rows are vectors of their own; other columns are ignored.
    Vectors are told apart by a 64-bit hash of their components.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    fit = F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 hash apart, so zeros are made positive.
    named = rows.select("vec_id", F.when(fit, F.xxhash64(F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0).cast(kind)).otherwise(v)))).alias("node"), "embedding")
    nodes = stage(
        named.where("node is not null").groupBy("node")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"),
             F.max(F.size("embedding")).alias("size")), "vectors",
    )
    n, dim = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits, tables = tables_for(n, cosine)
    coded = stage(nodes.select("node", "embedding").mapInArrow(_encode(dim, bits, tables), _CODED), "codes")
    sizes = coded.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    sizes = stage(sizes.select("tab", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), "m"), "hot")
    copies = int(sizes.agg(F.coalesce(F.sum(F.col("m") * (F.col("blocks") - 1)), F.lit(0))).first()[0])
    parts = max(parallelism(spark), math.ceil((n * tables + copies) / ROWS_A_TASK))
    named_bucket = F.xxhash64("tab", "key")
    hot = sizes.select(named_bucket.alias("bucket"), F.col("tab").alias("hot_tab"), F.col("key").alias("hot_key"), "blocks")
    same = (F.col("tab") == F.col("hot_tab")) & (F.col("key") == F.col("hot_key"))
    dealt = spread_join(coded.withColumn("bucket", named_bucket), hot, "bucket", "left", same, hot=sizes.select(named_bucket, "m")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Row of block o meets every block: as the first of (o, j) for j >= o and as the second of (i, o) for i < o.
    dealt = dealt.withColumn("o", own).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "tab", "key", F.least("o", "p").alias("i"), F.greatest("o", "p").alias("j"), (F.col("p") < F.col("o")).cast("int").alias("side"),
        "node", "code", "factor", "low", "step", "levels", "keys",
    )
    place = F.pmod(F.xxhash64("tab", "key", "i", "j"), F.lit(parts)).cast("int")
    active = stage(
        dealt.repartitionById(parts, place).mapInArrow(_candidates(dim, cosine), "tab int, key int, i int, j int, side int, node long"), "active"
    )
    held = active.join(nodes.select("node", "copies", "embedding"), "node")
    linked = stage(held.repartitionById(parts, place).mapInArrow(_exact(dim, bits, tables, cosine), "node long, links long, root long"), "links")
    classes = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = nodes.select("node", "rep", "copies").join(counts, "node", "left").join(classes, "node", "left").withColumn("class", F.coalesce("component", "node"))
    rooted = stage(rooted.select("node", "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class"), "rooted")
    least = rooted.groupBy("class").agg(F.min("rep").alias("component_id"))
    by_node = stage(rooted.join(least, "class").select("node", "n_links", "component_id"), "classes")
    drop(nodes, coded, sizes, active, linked, classes, rooted)
    return (
        named.select("vec_id", "node").join(by_node, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op7_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings"))

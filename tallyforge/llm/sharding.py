"""Sharding by sampled splitters.

Records are put in the order of (hash of the text, hash of the doc_id, row) so that equal texts stay together where a
shard has room for them. A size-weighted sample of the keys gives quantile boundaries of fine ranges; exact sums per range then show which
are overfull, and which hold a cut between two shards; both kinds are subdivided from new samples of their own.
Whole ranges are dealt to shards in order, so shards have near equal bytes, also when one text makes up a third of all
rows (its range is cut by doc_id, and rows that agree in both by the number each row is given when the keys are stored).
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import fresh, stage, table

Key = tuple[int, int, int]  # hash of the text, hash of the doc_id, number of the row
PARTS = ("h", "d", "r")
ROWS_A_RANGE, MOST_RANGES = 100_000, 4096  # the driver's share stays bounded: beyond, ranges hold more rows


def _below(splitter: Key | list[Column], strict: bool = True) -> Column:
    """Whether a splitter lies below the record's key, or not above it."""
    h, d, r = (x if isinstance(x, Column) else F.lit(x) for x in splitter)
    last = r < F.col("r") if strict else r <= F.col("r")
    return (h < F.col("h")) | ((h == F.col("h")) & ((d < F.col("d")) | ((d == F.col("d")) & last)))


def _range_of(splitters: list[Key]) -> Column:
    """Number of splitters not above the record's key, found by halving: eight comparisons for 256 splitters."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_below(splitters[mid], strict=False), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(splitters))


def _two_level(splitters: list[Key]) -> Column:
    """As ``_range_of``, but as a search in literal arrays: a coarse one, then its block; keeps generated code small."""
    width = max(16, math.isqrt(len(splitters)))
    if len(splitters) <= width:
        return _range_of(splitters)
    held = [F.array(*[F.lit(k[j]) for k in splitters]) for j in range(len(PARTS))]
    first = _range_of(splitters[width - 1 :: width]) * F.lit(width)
    inside = F.filter(
        F.sequence(first, F.least(first + F.lit(width - 1), F.lit(len(splitters) - 1))),
        lambda i: _below([F.get(x, i) for x in held], strict=False),
    )
    return F.when(first >= F.lit(len(splitters)), F.lit(len(splitters))).otherwise(first + F.size(inside)).cast("int")


def _sample(records: DataFrame, total: int, draws: int, turn: int) -> list[Key]:
    """Keys drawn with probability in proportion to size (a record of total/draws bytes or more is always drawn)."""
    u = F.pmod(F.xxhash64(F.lit(turn), *PARTS), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
    rows = records.where(u * F.lit(float(max(total, 1))) < F.col("size").cast("double") * F.lit(float(draws))).select(*PARTS).collect()
    return sorted({tuple(r) for r in rows})


def _quantiles(keys: list[Key], parts: int) -> list[Key]:
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def range_shards(records: DataFrame, shards: int = 8, fine: int = 256, oversample: int = 16, tolerance: float = 0.002, turns: int = 6) -> DataFrame:
    """Deal ``records`` (h, d, r, size: longs without nulls; more columns) to ``shards``; adds shard int and slot long.

    The key (h, d, r) should tell all records apart. fine: least ranges of the first round, which grow with the rows up to
    MOST_RANGES; oversample: keys drawn for each range. The driver holds some ten thousand keys and sums at most. A round
    subdivides ranges above twice the mean, and those that hold a cut and are larger than ``tolerance`` of a shard.
    Slots are gapless from 0 in key order within each shard. Empty input: no rows. Columns named shard or slot are replaced.
    """
    whole = records.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    total, rows = int(whole[0]), int(whole[1])
    fine = max(fine, min(MOST_RANGES, rows // ROWS_A_RANGE))
    own = [c for c in records.columns if c.lower() not in ("shard", "slot")]
    span, rank, before_it, of = (fresh([*own, "shard", "slot"], c) for c in ("range", "rank", "before", "place"))
    splitters = _quantiles(_sample(records, total, fine * oversample, 0), fine) if rows else []
    for turn in range(1, turns + 1):
        ranged = records.select(*own).withColumn(span, _two_level(splitters))
        sums = {r[0]: (int(r.bytes), int(r.n)) for r in ranged.groupBy(span).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
        sizes = [sums.get(i, (0, 0))[0] for i in range(len(splitters) + 1)]
        ends = [0]
        for s in sizes:
            ends.append(ends[-1] + s)
        wide = set()
        for i, s in enumerate(sizes):
            cut = any(ends[i] < total * k / shards < ends[i + 1] for k in range(1, shards))
            if sums.get(i, (0, 0))[1] > 1 and (s > 2 * total / fine or cut and s > tolerance * total / shards):
                wide.add(i)
        if not wide or turn == turns:
            break
        inside = ranged.where(F.col(span).isin(*wide))
        more: dict[int, list[Key]] = {}
        for key in _sample(inside, sum(sizes[i] for i in wide), oversample * 16 * len(wide), turn):
            more.setdefault(bisect.bisect_right(splitters, key), []).append(key)
        added = {k for keys in more.values() for k in [*_quantiles(keys, 16), keys[0]]} - set(splitters)
        if not added:
            break
        splitters = sorted({*splitters, *added})
    shard_of, before, counts = [], [], [0] * shards
    for i in range(len(splitters) + 1):
        middle = (ends[i] + ends[i + 1]) / 2
        shard = min(shards - 1, int(middle * shards / total)) if total else 0
        shard_of.append(shard)
        before.append(counts[shard])
        counts[shard] += sums.get(i, (0, 0))[1]
    place = F.broadcast(records.sparkSession.createDataFrame(  # one row a range
        list(zip(range(len(shard_of)), shard_of, before, strict=True)), f"{of} int, shard int, {before_it} long"
    ))
    order = Window.partitionBy(span).orderBy(*PARTS)
    return (
        ranged.withColumn(rank, F.row_number().over(order) - 1).join(place, F.col(span) == F.col(of))
        .select(*own, "shard", (F.col(before_it) + F.col(rank)).cast("long").alias("slot"))
    )


def shard_documents(documents: DataFrame, shards: int = 8, **options: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document, by law ``bytes``.

    size: UTF-8 bytes of the text plus 1; a null text counts as empty (size 1, CRC 0). Rows that agree in text and
    doc_id are kept, may take any of their slots, and are parted where a shard is full. A null doc_id is ordered as some
    number. Other columns are ignored.
    """
    records = stage(
        documents.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
            F.xxhash64("doc_id").alias("d"),
            F.monotonically_increasing_id().alias("r"),
        ),
        "keys",
    )
    return range_shards(records, shards, **options).select("doc_id", "size", "text_crc32", "shard", "slot")


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )



"""Best-fit packing of token documents into sequences, planned on the histogram of piece lengths.

Which pieces share a sequence depends on their lengths alone, and there are at most ``capacity`` lengths. So the plan is
made on the driver from counts by length: large items (above a third of the capacity) are matched, at most two a
sequence, the largest with the largest that still fits; smaller ones then best-fit the remaining gaps, largest first.
The plan is a list of patterns with multiplicities; its size is bounded by the capacity, not by the data. Pieces find
their sequence by their rank among pieces of equal length.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import fresh, parallelism, stage, table

CAPACITY = 1024
ROWS_A_SHARE = 100_000
END_ID = 2
REMEMBERED = 250_000  # words and pieces a worker's encoder remembers; other operators of a pipeline need room as well


@dataclass
class Pattern:
    """``bins`` sequences with the same lengths inside."""

    bins: int
    items: Counter = field(default_factory=Counter)

    def room(self, capacity: int) -> int:
        return capacity - sum(k * v for k, v in self.items.items())


def match_large(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Bins of one or two lengths above a third of the capacity: the largest left with the largest left that fits."""
    left = {k: v for k, v in counts.items() if 3 * k > capacity and v > 0}
    made = []
    for big in sorted(left, reverse=True):
        while left[big]:
            mate = max((k for k, v in left.items() if k <= capacity - big and v - (k == big) > 0), default=None)
            if mate is None:
                made.append(Pattern(left[big], Counter({big: 1})))
                left[big] = 0
            elif mate == big:
                made.append(Pattern(left[big] // 2, Counter({big: 2})))
                left[big] %= 2
            else:
                n = min(left[big], left[mate])
                made.append(Pattern(n, Counter({big: 1, mate: 1})))
                left[big] -= n
                left[mate] -= n
    return made


def best_fit(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Put the lengths of at most a third of the capacity into the smallest gaps that hold them, opening bins at need."""
    by_room: dict[int, list[Pattern]] = defaultdict(list)
    for p in patterns:
        by_room[p.room(capacity)].append(p)
    for small in sorted((k for k, v in counts.items() if 3 * k <= capacity and v > 0), reverse=True):
        n = counts[small]
        while n:
            gap = min((g for g, held in by_room.items() if g >= small and held), default=None)
            if gap is None:
                gap = capacity
                by_room[gap].append(Pattern(-(-n // (capacity // small))))
            p = by_room[gap].pop()
            each = min(gap // small, n)  # a bin is filled up before the next: its gap is then the smallest
            bins = min(p.bins, n // each)
            if bins < p.bins:
                by_room[gap].append(Pattern(p.bins - bins, Counter(p.items)))
            p.bins = bins
            p.items[small] += each
            by_room[gap - each * small].append(p)
            n -= bins * each
    return [p for held in by_room.values() for p in held if p.items]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """All patterns for ``counts`` (length to number of pieces)."""
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    made = best_fit(match_large(counts, capacity), counts, capacity)
    return sorted(made, key=lambda p: sorted(p.items.elements(), reverse=True), reverse=True)


def slots_of(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces a bin, first sequence, offset of the first in the bin) for every pattern and length."""
    rank: Counter = Counter()
    out, sequence = [], 0
    for p in patterns:
        offset = 0
        for length, each in sorted(p.items.items(), reverse=True):
            out.append((length, rank[length], rank[length] + each * p.bins, each, sequence, offset))
            rank[length] += each * p.bins
            offset += length * each
        sequence += p.bins
    return out


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity where it is cut."""
    first = size % capacity or capacity
    return [(0, min(first, size))] + [(s, capacity) for s in range(first, size, capacity)]


def token_pieces(documents: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (binary u32) of every row of ``documents`` (doc_id long, text), end_id appended.

    Null and empty texts are one piece of the end id alone. Repeated rows stay, other columns are ignored.
    """
    spec = bpe.load(documents.sparkSession, tokenizer or bpe.default_tokenizer())
    end = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoder(spec.value, False, REMEMBERED)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = encode(text) + end
                    for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        yield i, k, s, n, ids[4 * s : 4 * (s + n)]

        yield from bpe.in_batches(rows(), schema, lambda r: 40 + len(r[4]))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (length long from 1 to capacity, doc_id, piece, more columns).

    Ranks among equal lengths are counted in shares of rows dealt by their number in the staged table, so that one length
    (full pieces may be most of all) or one repeated row is many tasks' work, and a task that runs again gives the same
    ranks. Rows that agree in all columns are packed apart like any others. Columns named sequence_id or offset are
    replaced. No rows: no rows.
    """
    spark = pieces.sparkSession
    own = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    share, row, inside, base, rank, lo, hi, each, first, at, size = (
        fresh([*own, "sequence_id", "offset"], c) for c in ("share", "row", "inside", "base", "rank", "lo", "hi", "each", "first", "at", "size")
    )
    held = stage(pieces.select(*own).withColumn(row, F.monotonically_increasing_id()), "pieces")
    rows = held.count()
    shares = max(64, 4 * parallelism(spark), rows // ROWS_A_SHARE)
    dealt = held.withColumn(share, F.pmod(F.xxhash64(row), F.lit(shares)).cast("int"))
    counted = stage(dealt.groupBy("length", share).agg(F.count(F.lit(1)).alias("n")), "lengths")  # capacity x shares rows at most
    counts = {int(r.length): int(r.n) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = F.broadcast(spark.createDataFrame(  # bounded by the capacity
        slots_of(plan(counts, capacity)), f"{size} long, {lo} long, {hi} long, {each} long, {first} long, {at} long"
    ))
    ahead = Window.partitionBy("length").orderBy(share).rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", share, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias(base))
    order = Window.partitionBy("length", share).orderBy(row)
    ranked = dealt.withColumn(inside, F.row_number().over(order) - 1).join(bases, ["length", share]).withColumn(rank, F.col(base) + F.col(inside))
    placed = ranked.join(slots, (F.col("length") == F.col(size)) & (F.col(rank) >= F.col(lo)) & (F.col(rank) < F.col(hi)))
    past = F.col(rank) - F.col(lo)
    return placed.select(
        *own,
        (F.col(first) + F.floor(past / F.col(each))).cast("long").alias("sequence_id"),
        (F.col(at) + (past % F.col(each)) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame) -> DataFrame:
    """The query's columns for any documents; the ids are encoded once and kept as their CRC."""
    found = token_pieces(documents).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(found).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_large_item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

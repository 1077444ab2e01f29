"""Token files: every document compressed on its own by zstandard with one shared dictionary, with an offset index.

A data set is a folder of two tables: ``dictionary`` (one row: hash, dictionary) and ``segments``: part, segment, n_tokens,
the bounds of the doc_ids inside (lo, hi; nulls are not counted, ``nulls`` says whether there are any), and ``image``, a
complete binary segment:

    magic "TKSEG\\0\\0\\1" | unit u8, 7 bytes of padding | n u64 | base u64 | dictionary hash 16 bytes
    | n doc_ids i64 | n flags u8 (1: doc_id is null), padded to 8 | n+1 token starts u64 | n+1 byte starts u64 | frames

base: tokens before the segment in its part. A reader takes one document by three slices of the index and one frame;
``read_document`` finds its segment by the bounds, which Parquet's statistics prune as well.
unit: 2 where all ids are below 65,536, else 4 bytes an id, little-endian.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_path
from . import bpe
from .shared import drop, parallelism, stage, table

MAGIC = b"TKSEG\0\0\1"
HEAD = struct.Struct("<8sB7xQQ16s")
SEGMENT_BYTES = 512 << 10
#: The dictionary is trained on about this many documents, drawn by hash: of each a window of SAMPLE_IDS ids at a drawn
#: place (all of a shorter one), cut into arrays of at most SAMPLE_BYTES.
SAMPLED_DOCUMENTS, SAMPLE_IDS, SAMPLE_BYTES = 1500, 8 << 10, 8 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
REMEMBERED = 900_000  # words and pieces a worker's encoder remembers; nothing else runs beside it


def serialize(ids: bytes, unit: int) -> bytes:
    """Little-endian u32 ids to the file's unit."""
    return ids if unit == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(samples: list[bytes]) -> bytes:
    """A shared dictionary; raw content where there is too little to train on; empty without samples."""
    pieces = [s[i : i + SAMPLE_BYTES] for s in samples for i in range(0, len(s), SAMPLE_BYTES)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def hash_of(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def _zdict(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=_zdict(dictionary), write_dict_id=False)


def decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=_zdict(dictionary))


def write_segment(docs: list[tuple[int | None, int, bytes]], base: int, unit: int, dictionary_hash: bytes) -> bytes:
    """A segment of (doc_id, n_tokens, frame)."""
    n = len(docs)
    flags = bytes(d is None for d, _, _ in docs)
    ids = np.array([0 if d is None else d for d, _, _ in docs], "<i8")
    tokens, offsets = np.zeros(n + 1, "<u8"), np.zeros(n + 1, "<u8")
    np.cumsum([k for _, k, _ in docs], out=tokens[1:])
    np.cumsum([len(f) for _, _, f in docs], out=offsets[1:])
    return b"".join([
        HEAD.pack(MAGIC, unit, n, base, dictionary_hash), ids.tobytes(), flags + b"\0" * (-n % 8), tokens.tobytes(), offsets.tobytes(),
        *(f for _, _, f in docs),
    ])


class Segment:
    """Random access to the documents of one segment."""

    def __init__(self, image: bytes, dictionary: bytes) -> None:
        magic, self.unit, n, self.base, said = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if said != hash_of(dictionary):
            raise ValueError("the segment was written with another dictionary")
        at = HEAD.size
        self.image, self.n = image, n
        self.doc_ids = np.frombuffer(image, "<i8", n, at)
        at += 8 * n
        self.null = np.frombuffer(image, np.uint8, n, at)
        at += n + -n % 8
        self.tokens = np.frombuffer(image, "<u8", n + 1, at)
        at += 8 * (n + 1)
        self.offsets = np.frombuffer(image, "<u8", n + 1, at)
        self.frames = at + 8 * (n + 1)
        self.read = decompressor(dictionary)

    def doc_id(self, k: int) -> int | None:
        return None if self.null[k] else int(self.doc_ids[k])

    def places(self, doc_id: int | None) -> np.ndarray:
        """Numbers of the documents with this doc_id."""
        return np.flatnonzero(self.null == 1) if doc_id is None else np.flatnonzero((self.doc_ids == doc_id) & (self.null == 0))

    def ids(self, k: int) -> np.ndarray:
        """All ids of the k-th document."""
        a, b = self.frames + int(self.offsets[k]), self.frames + int(self.offsets[k + 1])
        raw = self.read.decompress(self.image[a:b])
        return np.frombuffer(raw, f"<u{self.unit}").astype("<u4")


def write_token_files(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Write ids of every row of ``documents`` (doc_id long, text), end_id appended, to ``path`` in ascending doc_id order.

    Null texts are empty, null doc_ids come first, rows with one doc_id follow the order of their texts' hashes, other
    columns are ignored, an empty table gives a dictionary and no segments. Documents are compressed where they are
    encoded; only frames go through the range shuffle.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = docs.count()
    # Neither repeated ids nor repeated rows are drawn together.
    drawn = F.pmod(F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text"), F.monotonically_increasing_id()), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLED_DOCUMENTS / max(n, 1)) * (1 << 40)))
    spec = bpe.load(spark, tokenizer or bpe.default_tokenizer())
    unit = 2 if max(len(bpe.vocabulary(spec.value).tokens) - 1, end_id) < 1 << 16 else 4
    sample = bpe.encode_documents(docs.where(drawn), tokenizer, own=False)
    end = struct.pack("<I", end_id)
    windows = F.greatest(F.lit(1), F.ceil(F.octet_length("ids") / (4 * SAMPLE_IDS)))
    pieces = F.substring("ids", (F.pmod(F.xxhash64(F.lit(8), "ids"), windows) * (4 * SAMPLE_IDS) + 1).cast("int"), F.lit(4 * SAMPLE_IDS))  # only to train on
    dictionary = train([serialize(bytes(r.ids) + end, unit) for r in sample.select(pieces.alias("ids")).collect()])
    spark.createDataFrame([(hash_of(dictionary), dictionary)], "hash binary, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")
    schema = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("frame", pa.binary())])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = bpe.encoder(spec.value, False, REMEMBERED), compressor(dictionary)

        def row(i: int | None, h: int, text: str | None) -> tuple:
            ids = encode(text) + end
            return i, h, len(ids) // 4, squeeze.compress(serialize(ids, unit))

        rows = (row(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from bpe.in_batches(rows, schema, lambda r: 24 + len(r[3]))

    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text")
    frames = stage(hashed.mapInArrow(compress, "doc_id long, h long, n long, frame binary"), "frames", "uncompressed")
    out = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("nulls", pa.bool_()), ("image", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, said = TaskContext.get().partitionId(), hash_of(dictionary)
        base = number = held = tokens = 0
        docs: list[tuple[int | None, int, bytes]] = []

        def done() -> pa.RecordBatch:
            named = [i for i, _, _ in docs if i is not None]
            row = part, number, tokens, min(named, default=None), max(named, default=None), len(named) < len(docs), write_segment(docs, base, unit, said)
            return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

        for b in batches:
            for i, _, k, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                docs.append((i, k, frame))
                tokens += k
                held += len(frame) + 25
                if held >= SEGMENT_BYTES:
                    yield done()
                    base, number, docs, held, tokens = base + tokens, number + 1, [], 0, 0
        if docs:
            yield done()

    ranged = frames.repartitionByRange(parallelism(spark), F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h", "n")
    ranged.mapInArrow(pack, "part int, segment int, n_tokens long, lo long, hi long, nulls boolean, image binary").write.option("compression", "uncompressed").parquet(f"{path}/segments")
    drop(frames)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and ids (binary u32) of a data set at ``path``.

    with_ids: without, ids are read and checked but stay null, as few queries need them.
    """
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    segments = spark.read.parquet(f"{path}/segments")
    before, total = [], 0
    for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # a row a partition
        before.append((r.part, total))
        total += r.n
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for base, image in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    s = Segment(image.as_py(), dictionary)
                    for k in range(s.n):
                        ids = s.ids(k).tobytes()
                        if len(ids) != 4 * int(s.tokens[k + 1] - s.tokens[k]):
                            raise ValueError("a document's ids don't agree with the index")
                        yield s.doc_id(k), base + s.base + int(s.tokens[k]), len(ids) // 4, zlib.crc32(ids), ids if with_ids else None

        yield from bpe.in_batches(rows(), schema, lambda r: 40 + len(r[4] or b""))

    return segments.join(starts, "part").select("before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_document(spark: SparkSession, path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of every document with this doc_id (null: None), in the order of the files; only segments whose bounds hold it are read."""
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first().dictionary)
    inside = F.col("nulls") if doc_id is None else (F.col("lo") <= doc_id) & (F.col("hi") >= doc_id)
    found = spark.read.parquet(f"{path}/segments").where(inside).orderBy("part", "segment").select("image")
    segments = (Segment(bytes(r.image), dictionary) for r in found.toLocalIterator())
    return [s.ids(int(k)) for s in segments for k in s.places(doc_id)]


def op2_zstd_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")

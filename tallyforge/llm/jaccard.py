"""Exact similarity join of documents on word shingles under the Jaccard metric.

Method: regions around pivots, divided recursively. The first pivots are one-shingle sets: a document's distance to the
pivot {s} is 1 - 1/size where it holds s, else 1, so its nearest pivots are its own shingles, and one global order (rare
before common) breaks the ties. Two documents within distance 0.2 meet in the region of one of their first
size - ceil(0.8 size) + 1 shingles, and a document is replicated to just those. Whole documents as only pivots would not
do: most lie at distance 1 from one another, and every triangle-inequality window would hold everything.

Every larger region begins with one of its documents as pivot: those within distance 0.2 are one class with it. Regions
whose documents then are of one class but for LISTED are listed. All others are divided, level by level, by documents: up
to PIVOTS of a region, of different classes where there are such, are its pivots; every document measures its distance
to each, and goes home to the Voronoi cell of the nearest one within the core radius. The distance is the Hamming distance
of wide parity bitmaps, a pseudo-metric that never exceeds the symmetric difference of the sets; a document of n shingles
links with none that is farther than its reach r = n / 4 (|x ^ y| <= (|x| + |y|) / 9 and |y| <= 5 |x| / 4). So, by the
triangle inequality, a document is replicated as a guest to the cells of all pivots that are nearer than the core radius
plus r and nearer than its nearest pivot plus 2 r, and no others; what lies outside every core is one more region, with
pivots of its own at the next level. Linked documents meet in a cell at every level. A cell that did not shrink is listed
too, in blocks. A list first takes each document's nearest candidates, and all pairs of classes that are still apart at the
next level, so a family of near copies is joined without all its pairs. Pairs that pass the bounds are compared by the
shingle sets themselves.

Shingles and sets are known by 64-bit hashes. Exact copies are one node, so a group of copies of any size costs what one
document costs after the first pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import components, drop, fresh, hot_keys, parallelism, sifted, spread_join, stage, table

WORDS = 5
#: Similarity 80 / 100.
PART, WHOLE = 80, 100
SMALL = 24  # documents of a region that lists its pairs at once
LISTED = 256  # documents outside a region's largest class up to which it is listed, not divided
NEAREST = 4  # candidates of a document that a list takes first
BLOCK = 256  # documents of a block of a larger region
PIVOTS = 16  # of a region that is divided
CORE = 0.75  # radius of the cells, in shingles of the pivots
SHRUNK = 0.7  # a cell with more of the documents of the region it comes from is compared in blocks
COPIES = 2.5  # a region is not divided into cells with so many times its documents
WIDE = 4  # a wide bitmap has so many bits for each bit of a narrow one
KEPT_SETS = 64  # sets that a comparing task keeps
BUCKET_ROWS = 2_000_000  # prefix shingles a bucket
HEAVY = 64  # documents with a shingle from which it comes late in the order
MOST_HEAVY = 1 << 17  # shingles that are ordered by frequency at most (1 MB); it changes the work, not the result
CHUNK = 1_000_000  # shingles held at once by a task
MOST_BITS = 1 << 18

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and 0x09 to 0x0D: just what bytes.lower and bytes.split do."""
    return (text or "").encode().lower().split()


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles; fewer words than the width are one shingle, none give none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    code = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    k = min(width, len(code))
    n = len(code) - k + 1
    h = np.full(n, k, np.uint64)
    for j in range(k):
        h = (h ^ code[j : j + n]) * _MULTIPLIERS[j % len(_MULTIPLIERS)]
        h ^= h >> np.uint64(32)
    return np.unique(h)


def node_of(found: np.ndarray) -> int:
    """A set's name: a signed 64-bit hash of its shingles."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def bitmap(found: np.ndarray, wide: int = 1) -> bytes:
    """Parity of the number of shingles that fall on each of 1 to 2 bits a shingle (a power of two, 64 at least), or ``wide`` times as many."""
    bits = wide * min(MOST_BITS, 64 << max(0, (len(found) - 1).bit_length() - 6))
    counts = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(a: bytes, size: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded by exclusive or to ``size`` bytes; stays the parity of the smaller modulus."""
    out = np.frombuffer(a, "<u8")
    while out.nbytes > size:
        half = len(out) // 2
        out = out[:half] ^ out[half:]
    return out


def folded(a: np.ndarray, size: int) -> np.ndarray:
    """As ``fold``, for a matrix with a bitmap a row."""
    while a.shape[1] * 8 > size:
        half = a.shape[1] // 2
        a = a[:, :half] ^ a[:, half:]
    return a


def most_apart(total: int | np.ndarray) -> int | np.ndarray:
    """Largest symmetric difference of two sets with sizes adding up to ``total`` that still link: 100 i >= 80 u."""
    return total * (WHOLE - PART) // (WHOLE + PART)


def prefix_size(n: int) -> int:
    return n - (PART * n + WHOLE - 1) // WHOLE + 1


def ordered(found: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's shingles in the global order as (light ones by hash, heavy ones by frequency)."""
    if not len(heavy):
        return found, found[:0]
    at = np.minimum(np.searchsorted(heavy, found), len(heavy) - 1)
    common = heavy[at] == found
    late = found[common]
    return found[~common], late[np.argsort(rank[at[common]], kind="stable")]


# ---- first pass: nodes and frequent shingles -------------------------------------------------------------------------

_FIRST = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("s", pa.int64()), ("c", pa.int64())])


def _batch(schema: pa.Schema, **columns: object) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe.forget()
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= 3
        return _batch(_FIRST, s=values[often].view(np.int64), c=counts[often])

    for b in batches:
        ids, texts, nodes, sizes, bits = [], [], [], [], []
        for i, text, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found = shingles(text)
            ids.append(i)
            texts.append(h)
            nodes.append(node_of(found) if len(found) else None)
            sizes.append(len(found))
            bits.append(bitmap(found) if len(found) else None)
            held.append(found)
            size += len(found)
            if size >= CHUNK:
                yield counted()
                held, size = [], 0
            if len(ids) >= 2000:
                yield _batch(_FIRST, doc_id=ids, h=texts, node=nodes, n=sizes, bits=bits)
                ids, texts, nodes, sizes, bits = [], [], [], [], []
        if ids:
            yield _batch(_FIRST, doc_id=ids, h=texts, node=nodes, n=sizes, bits=bits)
    if held:
        yield counted()


def frequent(first: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that come late in the order, sorted, with their rank by frequency. Every task counts all its documents."""
    counts = first.where("s is not null").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") > HEAVY)
    levels = sorted((int(r.level), int(r.n)) for r in counts.groupBy(F.floor(F.log2("c") * 4).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect())
    least, total = None, 0
    for level, n in reversed(levels):
        if total + n > MOST_HEAVY:
            break
        least, total = level, total + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.floor(F.log2("c") * 4) >= least).collect()
    s = np.array([r.s for r in rows], np.int64).view(np.uint64)
    c = np.array([r.c for r in rows], np.int64)
    order = np.lexsort((s, c))
    rank = np.empty(len(s), np.int64)
    rank[order] = np.arange(len(s))
    by_hash = np.argsort(s)
    return s[by_hash], rank[by_hash]


# ---- second pass: regions ------------------------------------------------------------------------------------------

_SECOND = pa.schema([("bucket", pa.int32()), ("block", pa.binary())])
LATE = -1  # the bucket in which a block of rows of frequent shingles says what it is
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("s", pa.int64()), ("node", pa.int64()), ("late", pa.bool_())])


def _pairs_of_runs(s: np.ndarray, node: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (a < b) that share a value of s in runs of up to SMALL nodes, and a mask of rows in longer runs.

    s, node: sorted by both, without repeated rows; n: the nodes' sizes, which rule pairs out.
    """
    if not len(s):
        return node[:0], node[:0], np.zeros(0, bool)
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    lengths = np.diff(np.r_[starts, len(s)])
    left, right = [], []
    for m in np.unique(lengths[(lengths > 1) & (lengths <= SMALL)]):
        at = starts[lengths == m][:, None] + np.arange(m)
        # Families share many regions: each set of members is taken once.
        at = at[np.unique([xxhash.xxh3_64_intdigest(r.tobytes()) for r in node[at]], return_index=True)[1]]
        i, j = (x.ravel() for x in (at[:, k] for k in np.triu_indices(int(m), 1)))
        fits = WHOLE * np.minimum(n[i], n[j]) >= PART * np.maximum(n[i], n[j])
        left.append(node[i[fits]])
        right.append(node[j[fits]])
    if not left:
        a = b = node[:0]
    else:
        both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
        a, b = both[:, 0], both[:, 1]
    return a, b, np.repeat(lengths > SMALL, lengths)


def _second_pass(heavy: np.ndarray, rank: np.ndarray, buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        seen: set[int] = set()
        light: list[np.ndarray] = []
        late: list[np.ndarray] = []
        names: list[tuple[int, int, int, int]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nodes, sizes, soon, then = (np.array(x, np.int64) for x in zip(*names, strict=True))
            for rows, each, kind in ((light, soon, 0), (late, then, LATE)):
                s = np.concatenate(rows)
                if not len(s):
                    continue
                bucket = (s * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                s, bucket = s[order], bucket[order]
                node, n = np.repeat(nodes, each)[order], np.repeat(sizes, each)[order].astype(np.uint32)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for lo, hi in zip(cuts, [*cuts[1:], len(s)], strict=True):
                    block = np.array([kind], np.int64).tobytes() + s[lo:hi].tobytes() + node[lo:hi].tobytes() + n[lo:hi].tobytes()
                    yield _batch(_SECOND, bucket=[int(bucket[lo])], block=[block])

        for b in batches:
            for text in b.column(0).to_pylist():
                found = shingles(text)
                if not len(found):
                    continue
                node = node_of(found)
                if node in seen:
                    continue
                seen.add(node)
                soon, then = ordered(found, heavy, rank)
                p = prefix_size(len(found))
                light.append(soon[:p])
                late.append(then[: max(0, p - len(soon))])
                names.append((node, len(found), len(light[-1]), len(late[-1])))
                size += p
                if size >= CHUNK:
                    yield from flush()
                    light, late, names, size = [], [], [], 0
        if names:
            yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of a partition's buckets: pairs of small regions, rows of larger ones. Rows of frequent shingles pass
    through, as only an aggregation that is partial before its shuffle can tell the size of their regions."""
    s, node, n = [], [], []
    for b in batches:
        for block in b.column(0).to_pylist():
            kind, rows = np.frombuffer(block, np.int64, 1)[0], (len(block) - 8) // 20
            parts = np.frombuffer(block, np.uint64, rows, 8), np.frombuffer(block, np.int64, rows, 8 + 8 * rows)
            if kind == LATE:
                yield _batch(_PAIRS, s=parts[0].view(np.int64), node=parts[1], late=np.ones(rows, bool))
            else:
                s.append(parts[0])
                node.append(parts[1])
                n.append(np.frombuffer(block, np.uint32, rows, 8 + 16 * rows).astype(np.int64))
    if not s:
        return
    s, node, n = np.concatenate(s), np.concatenate(node), np.concatenate(n)
    order = np.argsort(s, kind="stable")
    s, node, n = s[order], node[order], n[order]
    twice = np.r_[False, s[1:] == s[:-1]]
    twice[:-1] |= twice[1:]
    s, node, n = s[twice], node[twice], n[twice]
    order = np.lexsort((node, s))
    s, node, n = s[order], node[order], n[order]
    new = np.r_[True, (s[1:] != s[:-1]) | (node[1:] != node[:-1])] if len(s) else np.zeros(0, bool)
    s, node, n = s[new], node[new], n[new]
    a, b, large = _pairs_of_runs(s, node, n)
    for lo in range(0, len(a), 100_000):
        yield _batch(_PAIRS, a=a[lo : lo + 100_000], b=b[lo : lo + 100_000])
    if large.any():
        yield _batch(_PAIRS, s=s[large].view(np.int64), node=node[large], late=np.zeros(int(large.sum()), bool))


def _list_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of regions given as lists of nodes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for batch in batches:
        left, right = [], []
        for members in batch.column(0).to_pylist():
            m = np.sort(np.array(members, np.int64))
            i, j = np.triu_indices(len(m), 1)
            left.append(m[i])
            right.append(m[j])
        if left:
            both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], schema=schema)


# ---- comparison ----------------------------------------------------------------------------------------------------


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop pairs that sizes or bitmaps rule out. Columns: a, b, n and bits of both."""
    for batch in batches:
        na, nb = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        keep = WHOLE * np.minimum(na, nb) >= PART * np.maximum(na, nb)
        most = most_apart(na + nb)
        left, right = batch.column(3), batch.column(5)
        for k in np.flatnonzero(keep):
            x, y = left[k].as_py(), right[k].as_py()
            size = min(len(x), len(y))
            keep[k] = np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= most[k]
        yield batch.select([0, 1]).filter(pa.array(keep))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the intersection and the union of both sets, made anew from the packed texts; a node's pairs often follow one another."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("inter", pa.int64()), ("uni", pa.int64())])
    unpack = zstandard.ZstdDecompressor().decompress

    @lru_cache(KEPT_SETS)
    def found(packed: bytes) -> np.ndarray:
        return shingles(unpack(packed).decode())

    for batch in batches:
        inter, uni = [], []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            u, v = found(x.as_py()), found(y.as_py())
            i = len(np.intersect1d(u, v, assume_unique=True))
            inter.append(i)
            uni.append(len(u) + len(v) - i)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(inter, pa.int64()), pa.array(uni, pa.int64())], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, packed (a set of 64-bit shingles takes about three times the room of its packed text), with their bitmaps."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("packed", pa.binary()), ("bits", pa.binary()), ("wide", pa.binary())])
    bpe.forget()
    pack = zstandard.ZstdCompressor(3).compress
    seen: set[int] = set()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            rows = []
            for text in batch.column(0)[lo : lo + 500].to_pylist():
                x = shingles(text)
                if len(x) and (node := node_of(x)) not in seen:
                    seen.add(node)
                    rows.append((node, len(x), pack(text.encode()), bitmap(x), bitmap(x, WIDE)))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


# ---- cells -----------------------------------------------------------------------------------------------------------


def _bitmaps(group: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The width of each row's bitmap in bytes, and by width the rows and a matrix of theirs."""
    wide = group.column("wide").to_pylist()
    width = np.array([len(x) for x in wide])
    by_width = {}
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        by_width[int(w)] = rows, np.frombuffer(b"".join(wide[k] for k in rows), "<u8").reshape(len(rows), -1)
    return width, by_width


def _flags(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).to_numpy(zero_copy_only=False).astype(bool)


def cells_of(apart: np.ndarray, n: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Where documents go whose distances to the pivots are ``apart`` (a row a document) and whose sizes are ``n``: the home
    (number of a pivot, -1 outside all cores), and a matrix that marks the cells where they are guests."""
    reach = n[:, None] / 4
    least = apart.min(1)
    home = np.where(least <= radius, apart.argmin(1), -1)
    guest = (apart <= radius + reach) & (apart <= least[:, None] + 2 * reach)
    inside = np.flatnonzero(home >= 0)
    guest[inside, home[inside]] = False
    # Outside all cores there is no nearest one to compare with.
    guest[home < 0] = (apart <= radius + reach)[home < 0]
    return home, guest


_DIVIDED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cell", pa.int64()), ("node", pa.int64()), ("home", pa.bool_()), ("was", pa.int64()), ("parent", pa.int64())])


def _divide(group: pa.Table) -> pa.Table:
    """A block of a region with all pivots of it: the cells its documents go to, and pairs with the nearest pivot within reach."""
    node, kind, n = (group.column(c).to_numpy() for c in ("node", "class", "n"))
    pivot = _flags(group, "pivot")
    if pivot.all():
        return _DIVIDED.empty_table()
    width, by_width = _bitmaps(group)
    centres = np.flatnonzero(pivot)
    centres = centres[np.argsort(node[centres])]
    apart = np.zeros((len(node), len(centres)), np.int64)
    for w, (rows, matrix) in by_width.items():
        for k, c in enumerate(centres):
            size = min(w, int(width[c]))
            own_rows, own = by_width[int(width[c])]
            at = own[np.searchsorted(own_rows, c)][None]
            apart[rows, k] = np.bitwise_count(folded(matrix, size) ^ folded(at, size)).sum(1)
    members = np.flatnonzero(~pivot)
    apart = apart[members]
    node, kind, n, names = node[members], kind[members], n[members], node[centres]
    kinds, sizes = group.column("class").to_numpy()[centres], group.column("n").to_numpy()[centres]
    home, guest = cells_of(apart, n, CORE * float(np.median(sizes)))
    cell, was = group.column("cell")[0].as_py(), group.column("m")[0].as_py()
    child = np.array([np.uint64(xxhash.xxh3_64_intdigest(np.array([cell, p, k], np.int64).tobytes())).astype(np.int64) for k, p in enumerate([*names, 0])], np.int64)
    i, k = np.nonzero(guest)
    to = np.concatenate([child[home], child[k]])  # -1 is the last: outside all cores
    who = np.concatenate([node, node[i]])
    at_home = np.arange(len(to)) < len(node)
    near = apart.argmin(1)
    fits = (kind != kinds[near]) & (apart.min(1) <= most_apart(n + sizes[near])) & (WHOLE * np.minimum(n, sizes[near]) >= PART * np.maximum(n, sizes[near]))
    x, y = node[fits], names[near[fits]]
    def part(size: int, **columns: np.ndarray) -> pa.Table:
        return pa.table([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _DIVIDED], schema=_DIVIDED)

    return pa.concat_tables([
        part(len(to), cell=to, node=who, home=at_home, was=np.full(len(to), was), parent=np.full(len(to), cell)),
        part(len(x), a=np.minimum(x, y), b=np.maximum(x, y)),
    ])


def _list(group: pa.Table) -> pa.Table:
    """Pairs of a block of documents outside a cell's main class with a block of all, of different classes and one at home, that
    the bounds leave: each document's nearest ones, or all in the cell's second turn; a row with the cell alone, where there are more."""
    node, kind, n = (group.column(c).to_numpy() for c in ("node", "class", "n"))
    home, outer = _flags(group, "home"), _flags(group, "outer")
    nearest = None if group.column("last")[0].as_py() else NEAREST
    width, by_width = _bitmaps(group)
    inner = {w: (rows[~outer[rows]], matrix[~outer[rows]]) for w, (rows, matrix) in by_width.items()}
    left, right, more = [], [], False
    for k in np.flatnonzero(outer):
        own_rows, own = by_width[int(width[k])]
        own = own[np.searchsorted(own_rows, k)][None]
        near, gaps = [], []
        for w, (rows, matrix) in inner.items():
            fits = (kind[rows] != kind[k]) & (home[rows] | home[k]) & (WHOLE * np.minimum(n[rows], n[k]) >= PART * np.maximum(n[rows], n[k]))
            if not fits.any():
                continue
            size = min(w, int(width[k]))
            apart = np.bitwise_count(folded(matrix[fits], size) ^ folded(own, size)).sum(1)
            total = n[rows[fits]] + n[k]
            within = apart <= most_apart(total)
            near.append(rows[fits][within])
            gaps.append((apart / total)[within])
        if near:
            found, gap = np.concatenate(near), np.concatenate(gaps)
            more |= nearest is not None and len(found) > nearest
            found = found[np.lexsort((node[found], gap))][:nearest]
            left.append(np.minimum(node[found], node[k]))
            right.append(np.maximum(node[found], node[k]))
    a, b = (np.concatenate(x) if x else node[:0] for x in (left, right))
    cell = [None] * len(a) + [group.column("cell")[0].as_py()] * more
    return pa.table({"a": pa.array([*a, *[None] * more], pa.int64()), "b": pa.array([*b, *[None] * more], pa.int64()), "cell": pa.array(cell, pa.int64())})


class Join:
    """State of one join: nodes with their bitmaps, links found, classes so far."""

    def __init__(self, documents: DataFrame) -> None:
        self.spark = documents.sparkSession
        self.docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        told = self.docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        self.first = stage(told.mapInArrow(_first_pass, "doc_id long, h long, node long, n long, bits binary, s long, c long"), "nodes")
        self.members = self.first.where("n is not null").select("doc_id", "h", "node", "n")
        self.used = [self.first]
        # Copies meet in partial aggregates, so one text of any share of the rows is one row of a task here.
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")
        self.nodes = self.keep(
            self.first.where("node is not null").groupBy("node").agg(F.min(place).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "by-node"
        )

    def keep(self, df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
        self.used.append(stage(df, what, compression))
        return self.used[-1]

    def forget(self, *staged: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        drop(*staged)
        self.used = [x for x in self.used if not any(x is y for y in staged)]

    def regions(self) -> tuple[DataFrame, DataFrame]:
        """(a, b) of all small regions, and (cell, node, home, was) of the larger ones."""
        heavy, rank = frequent(self.first)
        prefixes = F.col("n") - F.ceil(F.col("n") * PART / WHOLE) + 1
        rows = self.nodes.agg(F.coalesce(F.sum(prefixes), F.lit(0)).cast("long")).first()[0]
        buckets = max(parallelism(self.spark), math.ceil(rows / BUCKET_ROWS))
        blocks = self.docs.select("text").mapInArrow(_second_pass(heavy, rank, buckets), "bucket int, block binary")
        met = self.keep(
            blocks.repartitionById(buckets, "bucket").select("block").mapInArrow(_meet, "a long, b long, s long, node long, late boolean"), "met"
        )
        rows = met.where("s is not null").groupBy("s", "node").agg(F.lit(1).alias("one")).select("s", "node")
        sizes = rows.groupBy("s").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"),
                                      F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 31))).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(1 << 31))).alias("y"))
        # Regions with the same members (their number, ends and two sums of hashes agree) are taken once.
        once = self.keep(sizes.where("m > 1").groupBy("m", "lo", "hi", "x", "y").agg(F.min("s").alias("s")).select("s", "m"), "once")
        regions = self.keep(rows.join(once, "s"), "regions")
        listed = regions.where(F.col("m") <= SMALL).groupBy("s").agg(F.collect_list("node").alias("members"))  # at most SMALL
        pairs = met.where("a is not null").select("a", "b").union(listed.select("members").mapInArrow(_list_pairs, "a long, b long"))
        larger = regions.where(F.col("m") > SMALL).select(F.col("s").alias("cell"), "node")
        # One pivot a region: the least by hash, so that a family's regions agree on it.
        least = larger.groupBy("cell").agg(F.min(F.struct(F.xxhash64(F.lit(3), "node").alias("h"), F.col("node").alias("pivot"))).alias("p")).select("cell", "p.pivot")
        cells = self.keep(larger.join(least, "cell").select("cell", "node", F.lit(True).alias("home"), F.lit(1 << 60).alias("was"), "pivot"), "cells")
        to_pivot = cells.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        pairs = self.keep(pairs.union(to_pivot).distinct(), "pairs")
        self.forget(met, once, regions)
        return pairs, cells

    def hot(self, pairs: DataFrame) -> list:
        """Nodes that are an end of more than a thousandth of the pairs."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        total = pairs.count()
        return hot_keys(ends.groupBy("node").agg(F.count(F.lit(1)).alias("m")), "node", total) if total > 1000 else []

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and narrow bitmaps leave."""
        def side(c: str) -> DataFrame:
            return self.nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))

        many = self.hot(pairs)
        both = spread_join(spread_join(pairs, side("a"), "a", many=many), side("b"), "b", many=many)
        return self.keep(both.select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(_near, "a long, b long"), "near")

    @staticmethod
    def of(table: DataFrame, nodes: DataFrame) -> DataFrame:
        """Rows of a table of nodes that are wanted, and some others, by a sieve in the scan."""
        named = table.withColumn("key", F.xxhash64("node"))
        return sifted(named, nodes.select(F.xxhash64("node").alias("key")), "key", "maybe").where("maybe").drop("key", "maybe")

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """node, n, packed, bits and wide of all ``wanted`` nodes and of some others, made anew from one document each.

        Documents are sifted by their name in the scan, at every size. What the sieve lets through beside them, and a node
        that several tasks made, does no harm: readers take one row a node.
        """
        reps = self.keep(self.nodes.join(wanted.distinct(), "node", "left_semi").select(F.xxhash64("rep.doc_id", "rep.h").alias("key")), "reps")
        told = self.docs.withColumn("key", F.xxhash64("doc_id", F.xxhash64("text")))
        found = sifted(told, reps, "key", "maybe").where("maybe")
        made = self.keep(found.select("text").mapInArrow(_sets, "node long, n long, packed binary, bits binary, wide binary"), "sets", "uncompressed")
        self.forget(reps)
        return made

    def test(self, near: DataFrame, many: list) -> DataFrame:
        """Links among the pairs (a, b), by their sets. many: the hot ends."""
        ends = near.select(F.explode(F.array("a", "b")).alias("node"))
        sets = self.of(self.sets.select("node", "packed"), ends).groupBy("node").agg(F.first("packed").alias("packed"))
        x, y = sets.toDF("a", "fa"), sets.toDF("b", "fb")
        both = spread_join(spread_join(near, x, "a", many=many), y, "b", many=many)
        tested = both.select("a", "b", "fa", "fb").mapInArrow(_compare, "a long, b long, inter long, uni long")
        return self.keep(tested.where(F.lit(WHOLE) * F.col("inter") >= F.lit(PART) * F.col("uni")).select("a", "b"), "links")

    def merged(self, classes: DataFrame, links: DataFrame, many: list) -> DataFrame:
        """(node, component) after more links: only classes that were apart are joined, so the graph is small."""
        def end(c: str) -> DataFrame:
            return classes.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))

        ends = spread_join(spread_join(links, end("a"), "a", "left", many=many), end("b"), "b", "left", many=many)
        apart = self.keep(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct(), "apart")
        if apart.isEmpty():
            return classes
        joined = components(apart)
        to = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
        moved = classes.join(to, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
        new = joined.join(classes, "node", "left_anti").select("node", "component")
        out = self.keep(moved.union(new), "classes")
        self.forget(apart)
        drop(joined)
        return out

    def run(self) -> DataFrame:
        """(node, component) of all nodes with a link, after all regions."""
        pairs, cells = self.regions()
        near = self.bounded(pairs)
        ends = near.select(F.explode(F.array("a", "b")).alias("node"))
        self.sets = self.sets_of(ends.union(cells.select("node")))
        links = self.test(near, self.hot(near))
        classes = components(links)
        self.used.append(classes)
        self.forget(pairs, near, links)
        level = 0
        if not cells.isEmpty():
            rows = self.of(self.sets.select("node", "n", "bits", "wide"), cells.select("node"))
            self.wide = self.keep(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bits", "wide")]), "wide", "uncompressed")
        cells = cells.drop("pivot")
        while not cells.isEmpty():
            level += 1
            before = list(self.used)
            pairs, cells = self.step(cells, classes, level)
            if not pairs.isEmpty():
                many = self.hot(pairs)
                classes = self.merged(classes, self.test(pairs, many), many)
            self.forget(*[x for x in self.used if x is not cells and x is not classes and not any(x is y for y in before)])
        self.forget(self.sets)
        return classes

    def step(self, cells: DataFrame, classes: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
        """Pairs to compare, and the cells that are left: those of the regions that were divided, and lists' second turns.

        was: the documents of the region a cell comes from; 0: it is to be listed; -1: it had its first turn.
        """
        of_node = classes.select("node", "component")
        at = self.keep(cells.join(of_node, "node", "left").select("cell", "node", "home", "was", F.coalesce("component", "node").alias("class")), "at")
        counts = at.groupBy("cell", "class").agg(F.count(F.lit(1)).alias("k"), F.max("was").alias("was"))
        sizes = counts.groupBy("cell").agg(F.max(F.struct("k", "class")).alias("most"), F.count(F.lit(1)).alias("classes"), F.sum("k").alias("m"), F.max("was").alias("was"))
        out = F.col("m") - F.col("most.k")
        main = self.keep(sizes.where("classes > 1").select(
            "cell", F.col("most.class").alias("main"), "m", out.alias("out"), ((out <= LISTED) | (F.col("m") > SHRUNK * F.col("was"))).alias("listed"),
            ((out <= SMALL) | (F.col("was") == -1)).alias("last"),
        ), "main")
        many = hot_keys(main, "cell")  # bounds what a cell's rows weigh in the joins below
        live = self.keep(spread_join(at.drop("was"), main, "cell", many=many), "live")
        # A list's first turn needs the narrow bitmaps only.
        rows = live.join(self.wide, "node").withColumn("wide", F.when(F.col("listed") & ~F.col("last"), F.col("bits")).otherwise(F.col("wide"))).drop("bits")

        def blocks(c: str) -> Column:
            return F.ceil(F.col(c) / BLOCK).cast("int")

        def own(c: str) -> Column:
            return F.pmod(F.xxhash64(F.lit(9), "node"), blocks(c)).cast("int")

        member = ["cell", "m", "node", "class", "home", "n", "wide"]
        listed = rows.where("listed").select(*member, "main", "out", "last")
        outer = listed.where(F.col("class") != F.col("main")).select(
            *member, "last", own("out").alias("i"), F.explode(F.sequence(F.lit(0), blocks("m") - 1)).alias("j"), F.lit(True).alias("outer"))
        every = listed.select(*member, "last", F.explode(F.sequence(F.lit(0), blocks("out") - 1)).alias("i"), own("m").alias("j"), F.lit(False).alias("outer"))
        compared = self.keep(outer.unionByName(every).groupBy("cell", "i", "j").applyInArrow(_list, "a long, b long, cell long"), "compared")
        more = compared.where("cell is not null").groupBy("cell").agg(F.lit(1).alias("more"))
        again = spread_join(live.where("listed").select("cell", "node", "home", F.lit(-1).cast("long").alias("was")), more, "cell", many=many).drop("more")
        compared = compared.where("a is not null").select("a", "b")
        if live.where("not listed").isEmpty():
            pairs, left = self.keep(compared.distinct(), "pairs"), self.keep(again, "cells")
            return pairs, left

        larger = rows.where("not listed")
        least = F.min(F.struct(F.xxhash64(F.lit(level), "node").alias("h"), *member[1:]))
        pivots = larger.where("home").groupBy("cell", F.pmod(F.xxhash64(F.lit(level), "class"), F.lit(PIVOTS)).alias("bucket")).agg(least.alias("p"))
        pivots = pivots.select("cell", *[F.col(f"p.{c}").alias(c) for c in member[1:]])
        dealt = larger.select(*member, own("m").alias("i"), F.lit(False).alias("pivot")).unionByName(
            pivots.select(*member, F.explode(F.sequence(F.lit(0), blocks("m") - 1)).alias("i"), F.lit(True).alias("pivot"))
        )
        divided = self.keep(dealt.groupBy("cell", "i").applyInArrow(_divide, "a long, b long, cell long, node long, home boolean, was long, parent long"), "divided")
        pairs = self.keep(compared.union(divided.where("a is not null").select("a", "b")).distinct(), "pairs")
        parts = divided.where("cell is not null")
        # Where the windows hold nearly everything, dividing gains nothing: the region is listed at the next level.
        vain = self.keep(
            parts.groupBy("parent").agg(F.count(F.lit(1)).alias("rows"), F.max("was").alias("m")).where(F.col("rows") > COPIES * F.col("m")).select("parent", F.lit(True).alias("vain")), "vain"
        )
        whole = spread_join(live.where("not listed").select(F.col("cell").alias("parent"), "node", "home"), vain, "parent", many=many).select(F.col("parent").alias("cell"), "node", "home", F.lit(0).cast("long").alias("was"))
        cut = spread_join(parts.select("parent", "cell", "node", "home", "was"), vain, "parent", "left", many=many).where("vain is null").select("cell", "node", "home", "was")
        left = self.keep(again.union(whole).union(cut), "cells")
        self.forget(divided, vain)
        return pairs, left


def join_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents`` (doc_id long, text).

    component_id: the smallest doc_id reachable by links, its own included. A null, empty or blank text has no shingles,
    links with nothing and is its own component. Equal texts link. Null doc_ids count as greater than all; where all of
    a component's are null, so is its id. Rows with one doc_id stay as they are; other columns are ignored.
    """
    join = Join(documents)
    classes = join.run()
    rooted = join.keep(join.nodes.join(classes, "node", "left").select("node", F.col("rep.doc_id").alias("rep"), F.coalesce("component", "node").alias("class")), "rooted")
    least = rooted.groupBy("class").agg(F.min("rep").alias("component_id"))
    by_node = join.keep(rooted.join(least, "class").select("node", "component_id"), "classes")
    out = stage(
        spread_join(join.members, by_node, "node", how="left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")),
        "joined",
    )
    drop(*join.used)
    return out


def one_of_each(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component, all columns as they are.

    It is the row of smallest doc_id (nulls last), then of the least hash of its text; of rows with one doc_id and one
    text, the least by all columns. Rows without shingles link with nothing, so each stays.

    Only rows that a sieve of the dropped and the repeated ones lets through are shuffled, at every size; all others stay
    where they are read.
    """
    join = Join(documents)
    classes = join.run()
    first = join.nodes.join(classes, "node", "left").groupBy(F.coalesce("component", "node").alias("class")).agg(F.min("rep").alias("rep"))
    kept = first.select(F.col("rep.doc_id").alias("id"), F.col("rep.h").alias("h"), F.lit(True).alias("kept"))
    rows = join.members.where("node is not null").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("m"))
    both = rows.join(kept, rows.doc_id.eqNullSafe(kept.id) & (rows.h == kept.h), "left").select(rows.doc_id, rows.h, "m", F.coalesce("kept", F.lit(False)).alias("kept"))
    own = documents.columns
    key, maybe, said, again, one = (fresh(own, c) for c in ("key", "maybe", "kept", "m", "id"))
    text = fresh(own, "h")
    # What is dropped, and what is kept once of several rows.
    told = join.keep(
        both.where("not kept or m > 1").select(F.col("doc_id").alias(one), F.col("h").alias(text), F.col("kept").alias(said), F.col("m").alias(again), F.xxhash64("doc_id", "h").alias(key)), "told"
    )
    named = documents.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")))
    sieved = sifted(named, told.select(key), key, maybe)
    stay = sieved.where(~F.col(maybe)).select(*own)
    exact = spread_join(sieved.where(maybe), told, key, how="left", same=F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & F.xxhash64("text").eqNullSafe(F.col(text)), hot=told.where(F.col(again) > 1).select(key, again))
    stay = stay.union(exact.where(F.col(said).isNull()).select(*own))
    # Of repeated rows the least stays; aggregates are partial before their shuffle.
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    least = exact.where(said).groupBy(key, one, text).agg(F.min(row).alias(key + "_row"))
    join.forget(*[x for x in join.used if x is not told])  # the result reads that one
    return stay.union(least.select(F.col(key + "_row").alias(key)).select(f"{key}.*"))


def op6_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(table(spark, sf_dir, "documents"))

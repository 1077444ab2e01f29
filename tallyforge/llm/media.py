"""Media columns: Netpbm and BMP to numpy, area resizing by integral images, NPY tiles and difference hashes."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop, stage, table

UNIT = 576  # bytes; the payload is padded to a positive multiple of it
WIDTH = 24  # samples a row of the stored image
_HEAD = re.compile(rb"P([1-6])((?:[ \t\r\n]|#[^\r\n]*[\r\n])+)(\d+)((?:[ \t\r\n]|#[^\r\n]*[\r\n])+)(\d+)")
_GAP = re.compile(rb"(?:[ \t\r\n]|#[^\r\n]*[\r\n])+")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap of a (height, width) uint8 array."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey (2 dimensions) or 24-bit (height, width, 3) BMP, rows bottom up and padded to four bytes."""
    h, w = samples.shape[:2]
    rows = samples.reshape(h, -1) if samples.ndim == 2 else samples[:, :, ::-1].reshape(h, -1)
    body = np.zeros((h, -(-rows.shape[1] // 4) * 4), np.uint8)
    body[:, : rows.shape[1]] = rows[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if samples.ndim == 2 else np.zeros((0, 4), np.uint8)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if samples.ndim == 2 else 24, 0, body.size, 2835, 2835, len(palette), 0)
    return head + info + palette.tobytes() + body.tobytes()


def _decode_netpbm(data: bytes) -> np.ndarray:
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a Netpbm header")
    kind, w, h, at = int(m[1]), int(m[3]), int(m[5]), m.end()
    channels = 3 if kind in (3, 6) else 1
    most = 1
    if kind not in (1, 4):
        g = _GAP.match(data, at)
        n = re.compile(rb"\d+").match(data, g.end()) if g else None
        if not n:
            raise ValueError("no maximum value")
        most, at = int(n[0]), n.end()
        if not 0 < most < 65536:
            raise ValueError("maximum value out of range")
    if kind in (1, 2, 3):
        text = re.sub(rb"#[^\r\n]*", b"", data[at:])
        words = [b"%c" % c for c in text if c in b"01"] if kind == 1 else text.split()
        flat = np.array(words[: w * h * channels], dtype="S5").astype(np.int64) if words else np.zeros(0, np.int64)
    elif kind == 4:
        stride = -(-w // 8)
        packed = np.frombuffer(data, np.uint8, h * stride, at + 1).reshape(h, stride)
        flat = np.unpackbits(packed, axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * channels, at + 1)
    if flat.size < w * h * channels:
        raise ValueError("too few samples")
    if flat.size and int(flat.max()) > most:
        raise ValueError("a sample above the maximum")
    if kind in (1, 4):
        flat = (1 - flat) * 255  # 1 is black
    elif most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    shape = (h, w, 3) if channels == 3 else (h, w)
    return flat.astype(np.uint8).reshape(shape)


def _decode_bmp(data: bytes) -> np.ndarray:
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing != 0 or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("only uncompressed BMP with 1, 4, 8, 24 or 32 bits")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, start).reshape(abs(h), stride)
    if h > 0:
        rows = rows[::-1]
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].copy()
    if bits == 8:
        codes = rows[:, :w]
    elif bits == 4:
        codes = np.stack([rows >> 4, rows & 15], -1).reshape(abs(h), -1)[:, :w]
    else:
        codes = np.unpackbits(rows, axis=1)[:, :w]
    n = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, n * 4, 14 + size).reshape(n, 4)[:, 2::-1]
    if codes.size and codes.max() >= n:
        raise ValueError("colour beyond the palette")
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return palette[codes, 0] if grey else palette[codes]


def decode_image(data: bytes) -> np.ndarray:
    """uint8 array (height, width) or (height, width, 3) of a Netpbm (P1 to P6) or BMP file; ValueError if it is neither."""
    try:
        if data[:2] == b"BM":
            return _decode_bmp(data)
        return _decode_netpbm(data)
    except (struct.error, IndexError) as e:
        raise ValueError(f"broken image: {e}") from e


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area, fractions of source samples included, from one integral image."""
    grey = image if image.ndim == 2 else image.astype(np.uint32) @ np.array([299, 587, 114], np.uint32) // 1000
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1), np.int64)
    np.cumsum(np.cumsum(grey, 0, dtype=np.int64), 1, out=total[1:, 1:])

    def at(n: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.arange(cells + 1) * (n / cells)
        lo = np.minimum(edge.astype(np.int64), n - 1)
        return lo, edge - lo

    y, fy = at(h, height)
    x, fx = at(w, width)
    rows = total[y] + (total[y + 1] - total[y]) * fy[:, None]  # the integral is linear inside a sample
    corner = rows[:, x] + (rows[:, x + 1] - rows[:, x]) * fx
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return np.clip(np.rint(sums / ((h / height) * (w / width))), 0, 255).astype(np.uint8)


def npy_bytes(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 cells is darker than its right neighbour in a 9 x 8 area-resized image."""
    small = area_resize(image, 8, 9)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length in UTF-8, and the bytes padded with 255 to a positive multiple of 576. Null counts as empty."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * ((-len(raw)) % UNIT or UNIT * (not raw))


def store_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a binary greymap of the padded text, 24 samples wide) for every document, stored as a table.

    Any text has an image: null and empty texts one of 24 x 24 white samples. Repeated rows stay; other columns go.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, media = [], []
            for text in pdf["text"]:
                size, payload = payload_of(text)
                n.append(size)
                media.append(encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": np.array(n, np.int64), "media": media})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return stage(documents.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary"), "media")


def media_features(media: DataFrame, tile: int = 16) -> DataFrame:
    """For every row of ``media`` (a binary column media, others kept): width, height, samples, tile and dhash.

    samples: the decoded array's bytes in row order; tile: the image area-resized to tile x tile, as an NPY file's bytes;
    dhash: the difference hash. A null or broken image gives nulls. Columns of these names are replaced.
    """
    made = {"width": "int", "height": "int", "samples": "binary", "tile": "binary", "dhash": "string"}
    keep = [f for f in media.schema if f.name not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{k} {v}" for k, v in made.items())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for data in pdf["media"]:
                try:
                    image = decode_image(bytes(data)) if data is not None else None
                except ValueError:
                    image = None
                if image is None or not image.size:
                    rows.append((None,) * 5)
                else:
                    rows.append((image.shape[1], image.shape[0], image.tobytes(), npy_bytes(area_resize(image, tile, tile)), difference_hash(image)))
            new = pd.DataFrame(rows, columns=list(made), index=pdf.index, dtype=object)
            yield pd.concat([pdf[names], new], axis=1)

    return media.mapInPandas(run, schema)


def write_tiles(media: DataFrame, tile: int = 16) -> DataFrame:
    """The rows of ``media`` (a binary column media, others kept but for media) with digests, and its tile as the bytes of an
    NPY file, written to the shared folder and read back.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the decoded samples), media_bytes, media_sha256, dhash and tile, which
    are null (media_bytes and media_sha256 only for a null image) where an image is null or broken; such columns are replaced.
    """
    made = {
        "payload_bytes": F.octet_length("samples").cast("long"), "payload_sha256": F.sha2("samples", 256), "tail_crc32": F.crc32(F.substring("samples", -32, 32)),
        "media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256), "dhash": F.col("dhash"), "tile": F.col("tile"),
    }
    found = media_features(media, tile)
    keep = [c for c in media.columns if c not in ("media", "width", "height", "samples", *made)]
    return stage(found.select(*keep, *[v.alias(k) for k, v in made.items()]), "tiles")


def op3_netpbm_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored as greymaps, read back and decoded; the digests are of what was read back, the feature of the stored tile."""
    media = store_documents(table(spark, sf_dir, "documents"))
    tiles = write_tiles(media)
    drop(media)
    feature = F.concat_ws(":", "dhash", F.sha2("tile", 256)).alias("feature")
    return tiles.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature)

"""Byte-level BPE: exact splitting into pieces, a backtracking encoder, a table-driven decoder, and the library's encoder.

A tokenizer is its JSON text; it is read where the driver runs and sent to executors as a broadcast of a few MB.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: How this kind of tokenizer cuts a text before merging.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters on whose classes all Unicode versions agree; a text with others is cut by the library.
_SETTLED = regex.compile(r"[^\u0000-՗ -⁯₠-₿℀-⅏　-ヿ一-龥가-힣\U0001f300-\U0001f5ff]")
#: What keeps a text from being cut at its spaces: rare characters, and white space other than spaces and line feeds.
_UNCOMMON = re.compile(r"[^\n !-~\u00a1-\u024f\u0400-\u045f\u2013\u2014\u2018-\u201e\u2022\u2026\u20ac]")
#: Words and pieces whose ids a worker remembers, and the longest such one. Past this number of each no more are added: those seen first are the frequent ones.
REMEMBERED, LONGEST = 500_000, 48
#: Bytes of a result batch.
BATCH_BYTES = 8 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file, by the public byte-level rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges as pairs of ids, special strings, and the offset table for decoding."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        alphabet = byte_alphabet()
        model = spec["model"]
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.tokens: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.tokens[i] = bytes(alphabet[c] for c in token)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = {t: i for i, t in enumerate(self.tokens) if t}
        for content, i in self.special.items():
            self.tokens[i] = content.encode()
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = model["vocab"][left], model["vocab"][right]
            whole = model["vocab"][left + right]
            self.merged[a, b] = whole
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (a, b), r
        self.plain = plain
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(t) for t in self.tokens], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Concatenates the ids' slices of one table of bytes, all at once."""
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        if not len(ends):
            return b""
        return self.blob[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD. ids: int64, all in the vocabulary."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


class BacktrackingEncoder:
    """Ids of a piece in time linear in its length.

    The encoding of a prefix extends the one chosen before if the two last tokens can stand side by side in some BPE
    result. So the longest token at the current place is tried first, then its prefixes; where none fits its left
    neighbour, the last token is given up for its own next prefix. An end that failed once is never tried again.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.length = [len(t) for t in vocabulary.tokens]
        self.matches = ahocorasick.Automaton()
        for token, i in vocabulary.plain.items():
            self.matches.add_word(token.decode("latin-1"), i)
        self.matches.make_automaton()
        self.shorter = [-1] * len(vocabulary.tokens)
        for token, i in vocabulary.plain.items():
            self.shorter[i] = next((vocabulary.plain[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in vocabulary.plain), -1)
        self.fits: dict[tuple[int, int], bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE over the joined bytes of a and b ends in (a, b): no merge across the seam would have come first.

        Walks the seam's two sides back through the merges that made them, latest first; a merge of the parts then
        facing each other that precedes the step just undone would have taken the place of that step.
        """
        key = a, b
        known = self.fits.get(key)
        if known is None:
            known = self._compatible(a, b)
            if len(self.fits) < 300_000:
                self.fits[key] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        v, never = self.v, len(self.v.rank) + 1
        undone = (never, 0)  # rank of the step undone last; equal ranks go to the left place first
        while True:
            whole = v.merged.get((a, b))
            if whole is not None and (v.rank[whole], 1) < undone:
                return False
            ra, rb = v.rank.get(a, -1), v.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                undone, a = (ra, 0), v.halves[a][1]
            else:
                undone, b = (rb, 2), v.halves[b][0]

    def encode(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, token in self.matches.iter(piece.decode("latin-1")):
            start = end + 1 - self.length[token]
            if longest[start] < 0 or self.length[longest[start]] < self.length[token]:
                longest[start] = token
        if n and self.length[longest[0]] == n and self._whole(longest[0]):
            return [longest[0]]
        open_end = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.length[token]
                if open_end[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = self.shorter[token]
            else:
                open_end[at] = 0
                out.pop()
                at -= self.length[last]
                token = self.shorter[last]
                continue
        return out

    def _whole(self, token: int) -> bool:
        return token in self.v.rank or self.length[token] == 1


def split_pieces(text: str, pattern: regex.Pattern, library: Callable[[], object]) -> list[str]:
    if _SETTLED.search(text):
        found = library().pre_tokenizer.pre_tokenize_str(text)
        return [text[s:e] for _, (s, e) in found]
    return pattern.findall(text)


class TextEncoder:
    """Whole texts to ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them.

    Most texts are cut at their spaces: a piece never spans a space that has a visible character on either side, so a
    word's ids with the space before it don't depend on its surroundings and are remembered. Texts with other white
    space beside spaces, or with characters outside the common ranges, are cut into pieces one by one.
    """

    def __init__(self, spec: str, own: bool, remembered: int | None = None) -> None:
        self.spec, self.own, self.made = spec, own, None
        self.v = Vocabulary(spec)
        self.pattern = regex.compile(PIECE)
        self.spelled = {b: c for c, b in byte_alphabet().items()}
        self.most = remembered or (REMEMBERED // 2 if own else REMEMBERED)  # the own encoder's tables take room too
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.encoder = BacktrackingEncoder(self.v) if own else None

    def library(self) -> object:
        if self.made is not None:
            return self.made
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.made = Tokenizer.from_str(self.spec)
        self.made.no_truncation()
        self.made.no_padding()
        return self.made

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        parts = self.v.cut_special.split(text) if self.v.cut_special and any(s in text for s in self.v.special) else [text]
        return b"".join(
            array("I", [self.v.special[part]]).tobytes() if part in self.v.special else self._plain(part) for part in parts if part
        )

    def _plain(self, text: str) -> bytes:
        if "   " in text or " \n" in text or "\n " in text or _UNCOMMON.search(text):
            return b"".join(self._pieces(split_pieces(text, self.pattern, self.library)))
        head, *words = text.split(" ")
        known = self.words
        found = list(map(known.get, words))
        new = {w for w, ids in zip(words, found, strict=True) if ids is None}
        if new:
            cut = [self.pattern.findall(" " + w) for w in new]
            ids = iter(self._pieces([p for pieces in cut for p in pieces]))
            made = {w: b"".join(islice(ids, len(pieces))) for w, pieces in zip(new, cut, strict=True)}
            found = [made[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
            if len(known) < self.most:
                known.update((w, ids) for w, ids in made.items() if len(w) <= LONGEST)
        return b"".join(self._pieces(self.pattern.findall(head)) + found)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; what is new is encoded in one call and remembered."""
        known = self.pieces
        found = list(map(known.get, pieces))
        new = list({p for p, ids in zip(pieces, found, strict=True) if ids is None})
        if new:
            made = dict(zip(new, self._encode(new), strict=True))
            found = [made[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
            if len(known) < self.most:
                known.update((p, ids) for p, ids in made.items() if len(p) <= LONGEST)
        return found

    def _encode(self, pieces: list[str]) -> Iterator[bytes]:
        if self.own:
            return (array("I", self.encoder.encode(p.encode())).tobytes() for p in pieces)
        model, spelled = self.library().model, self.spelled
        return (array("I", [t.id for t in model.tokenize(p.encode().decode("latin-1").translate(spelled))]).tobytes() for p in pieces)


_made: dict[tuple[str, bool, int | None], TextEncoder] = {}


def forget() -> None:
    """Free what a worker's encoders remember; for operators that run in the same workers afterwards."""
    _made.clear()


def encoder(spec: str, own: bool, remembered: int | None = None) -> TextEncoder:
    """One encoder of a kind a worker process, with what it remembers."""
    key = hashlib.sha256(spec.encode()).hexdigest(), own, remembered
    if key not in _made:
        _made[key] = TextEncoder(spec, own, remembered)
    return _made[key]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(spec: str) -> Vocabulary:
    if spec not in _vocabularies:
        _vocabularies[spec] = Vocabulary(spec)
    return _vocabularies[spec]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(spark: SparkSession, path: str) -> Broadcast:
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def in_batches(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode_documents(documents: DataFrame, tokenizer: str | None = None, own: bool = True) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of every row of ``documents`` (doc_id long, text).

    own: by the backtracking encoder, else by the library. A null or empty text has no ids. Rows keep their number and
    order within partitions; other columns are ignored.
    """
    spec = load(documents.sparkSession, tokenizer or default_tokenizer())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec.value, own)
        rows = ((i, encode(t)) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from in_batches(rows, schema, lambda r: 16 + len(r[1]))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and decoded (string) of rows as ``encode_documents`` gives them. Null ids decode to a null text.

    Ids outside the vocabulary raise; byte sequences that aren't UTF-8 become U+FFFD.
    """
    spec = load(encoded.sparkSession, tokenizer or default_tokenizer())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(spec.value)
        rows = (
            (i, ids, None if ids is None else v.decode(np.frombuffer(ids, "<u4").astype(np.int64)))
            for b in batches for i, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        )
        yield from in_batches(rows, schema, lambda r: 16 + 2 * len(r[1] or b""))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids and decoded of every row, encoded by the backtracking encoder and decoded from the ids in one pass.

    Nulls and empty texts as in ``encode_documents``; both have an empty decoded text.
    """
    spec = load(documents.sparkSession, tokenizer or default_tokenizer())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(spec.value, True)

        def row(i: int | None, text: str | None) -> tuple:
            ids = encode(text)
            return i, ids, encode.v.decode(np.frombuffer(ids, "<u4").astype(np.int64))

        rows = (row(i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from in_batches(rows, schema, lambda r: 16 + 2 * len(r[1]))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op9_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )

"""Quality classifier without hand labels.

Overlapping heuristic labellers vote good, junk or nothing on every document. Expectation-maximisation over the counts
of vote patterns of the whole corpus estimates each labeller's accuracy and the share of good documents. The posteriors
label a bounded sample, on which a hashed linear scorer is trained; it scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import drop, stage, table

GOOD, JUNK, NONE = 1, 0, 2
#: The scorer is trained on about this many documents, drawn by hash; all documents vote and are scored.
TRAINED = 6000
BITS = 10  # hashed features: 2 ** BITS
KEEP = 0.5  # least score of a document that is kept
REMEMBERED = 200_000  # words a worker knows the features of

_SUFFIX = frozenset("*&%$#@~^=+<>")


def _votes(text: str, words: list[str]) -> list[int]:
    n = len(words)
    if not n:
        return [NONE] * len(LABELLERS)
    upper = sum(map(str.isupper, words)) / n
    shout = text.count("!") / n
    marks = sum(map(text.count, "*&%$#@~^=+<>|!{}\\")) / len(text)
    bars = (words.count("|") + words.count("-") + words.count("•")) / n
    same = sum(map(str.__eq__, words, words[1:])) / max(1, n - 1)
    distinct = min(len(set(words[k : k + 400])) / min(n, 400) for k in [*range(0, n - 400, 400), max(0, n - 400)])  # the last window ends with the text
    tail = sum(w[-1] in _SUFFIX for w in words) / n
    plain = sum(map(str.isalpha, map(str.lower, (w.strip(".,;:?") for w in words)))) / n

    def junk(found: bool) -> int:
        return JUNK if found else NONE

    return [
        junk(upper > 0.5), junk(shout > 0.3), junk(marks > 0.1), junk(bars > 0.2), junk(same > 0.4 and n >= 5),
        NONE if n < 20 else JUNK if distinct < 0.3 else GOOD if distinct > 0.4 else NONE,
        junk(tail > 0.3),
        JUNK if plain < 0.6 or same > 0.5 and n >= 5 else GOOD if plain > 0.9 and same < 0.1 and (n < 20 or distinct > 0.3) else NONE,
    ]


LABELLERS = ("capitals", "exclamations", "marks", "bars", "repeats", "variety", "suffixes", "prose")


def pattern_of(text: str | None) -> int:
    """The votes as digits to base 3, first labeller lowest."""
    text = text or ""
    return sum(v * 3**k for k, v in enumerate(_votes(text, text.split())))


def unpack(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(len(LABELLERS))]


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and what each labeller says of either class: chance[labeller, class, vote]."""

    good: float
    chance: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of being good for each row of votes."""
        odds = np.full(len(patterns), np.log(self.good / (1 - self.good)))
        for j in range(patterns.shape[1]):
            odds += np.log(self.chance[j, GOOD] / self.chance[j, JUNK])[patterns[:, j]]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    @property
    def accuracy(self) -> np.ndarray:
        """Chance that a labeller's vote is right, where it votes: [labeller, class]."""
        return np.stack([self.chance[:, c, c] / (self.chance[:, c, GOOD] + self.chance[:, c, JUNK]) for c in (JUNK, GOOD)], 1)


def fit_label_model(counts: dict[int, int], turns: int = 100) -> LabelModel:
    """Expectation-maximisation over pattern counts, with votes taken as independent given the class.

    At most 3 ** labellers patterns, whatever the corpus. Silence is an outcome too, so that labellers that know one
    kind of junk only still tell. Starts from labellers that seldom call a good document junk; one pseudo-count an
    outcome keeps chances inside 0 and 1.
    """
    votes = np.array([unpack(p) for p in counts], np.int64).reshape(-1, len(LABELLERS))
    n = np.array(list(counts.values()), float)
    start = np.empty((2, 3))
    start[JUNK, [JUNK, GOOD, NONE]], start[GOOD, [JUNK, GOOD, NONE]] = (0.35, 0.25, 0.4), (0.02, 0.5, 0.48)
    model = LabelModel(0.8, np.tile(start, (len(LABELLERS), 1, 1)))
    for _ in range(turns if len(n) else 0):
        p = model.posterior(votes)
        good = float((n @ p + 1) / (n.sum() + 2))
        chance = np.empty_like(model.chance)
        for c, w in ((GOOD, n * p), (JUNK, n * (1 - p))):
            for v in (JUNK, GOOD, NONE):
                chance[:, c, v] = ((votes == v).T @ w + 1) / (w.sum() + 3)
        model = LabelModel(min(max(good, 1e-6), 1 - 1e-6), chance)
    return model


# ---- features --------------------------------------------------------------------------------------------------------


def _shape(word: str) -> bytes:
    """Form of a word with runs folded to one sign: A, a, 9 or the mark itself."""
    out, last = [], ""
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if s != last:
            out.append(s)
            last = s
    return "".join(out).encode()


class Features:
    """Hashed counts of word forms, of pairs of forms, and of words that repeat the one before, divided by the words and 8 more."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        made = np.array([crc32(_shape(word)), crc32(word.encode())], "<u4").tobytes()
        if len(self.known) < REMEMBERED:
            self.known[word] = made
        return made

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        out = np.zeros(1 << BITS, np.float32)
        if not words:
            return out
        get, new = self.known.get, self._word
        codes = np.frombuffer(b"".join([get(w) or new(w) for w in words]), "<u4").reshape(-1, 2).astype(np.uint64)
        form, word = codes[:, 0], codes[:, 1]
        single = form * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
        again = (word[1:] == word[:-1]).astype(np.uint64)
        pair = (form[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + form[:-1] * np.uint64(0x165667B19E3779F9) + again * np.uint64(0x27D4EB2F165667C5)) >> np.uint64(64 - BITS)
        out += np.bincount(single.astype(np.int64), minlength=1 << BITS)
        out += np.bincount(pair.astype(np.int64), minlength=1 << BITS)
        return out / np.float32(len(words) + 8)  # few words say little


def train_scorer(x: np.ndarray, p: np.ndarray, turns: int = 300, rate: float = 2.0, decay: float = 1e-5) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer for soft labels p, classes weighted alike, by full-batch Adam."""
    w = np.zeros(x.shape[1] + 1)
    if not len(x):
        return w
    x = x.astype(float)
    weight = p / max(p.sum(), 1e-9) + (1 - p) / max((1 - p).sum(), 1e-9)
    weight /= weight.sum()
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, turns + 1):
        z = x @ w[:-1] + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - p)
        grad = np.append(x.T @ g, g.sum()) + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


# ---- the operator ----------------------------------------------------------------------------------------------------


def fit(documents: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The label model from the votes of all documents, and the scorer's weights from a sample of TRAINED documents.

    A row is drawn by a hash of its doc_id, its text and its place in the table, so that neither repeated ids nor repeated
    rows are drawn together: the sample's size is binomial, about TRAINED. An empty table gives a model that scores every
    text 0.5.
    """
    n = documents.count()
    share = min(1.0, TRAINED / max(n, 1))
    drawn = F.pmod(F.xxhash64(F.lit(5), "doc_id", F.xxhash64("text"), F.monotonically_increasing_id()), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))
    schema = pa.schema([("pattern", pa.int32()), ("features", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        features = Features()
        rows = (
            (pattern_of(t), features(t).tobytes() if d else None)
            for b in batches for t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        )
        yield from bpe.in_batches(rows, schema, lambda r: 16 + len(r[1] or b""))

    votes = stage(documents.select("text", drawn.alias("drawn")).mapInArrow(run, "pattern int, features binary"), "votes")
    model = fit_label_model({r.pattern: r.n for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()})
    rows = votes.where("features is not null").collect()
    drop(votes)
    x = np.array([np.frombuffer(r.features, np.float32) for r in rows]).reshape(-1, 1 << BITS)
    p = model.posterior(np.array([unpack(r.pattern) for r in rows], np.int64).reshape(-1, len(LABELLERS)))
    weights = train_scorer(x, p)
    weights[-1] += np.log(model.good / (1 - model.good))  # it was trained on classes of equal weight
    return model, weights


def score_documents(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """``documents`` with score (double, 0 to 1) and keep (score of KEEP or more) beside all their columns.

    A text without words (null, empty, white space) scores 0. Columns of these names are replaced; repeated rows stay.
    """
    own = documents.select(*[c for c in documents.columns if c not in ("score", "keep")])
    at = own.columns.index("text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        features = Features()
        for b in batches:
            scores = []
            for t in b.column(at).to_pylist():
                z = float(features(t) @ weights[:-1] + weights[-1])
                scores.append(round(1 / (1 + np.exp(-min(60.0, max(-60.0, z)))), 9) if t and not t.isspace() else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    return own.mapInArrow(run, schema).withColumn("keep", F.col("score") >= KEEP)


def op5_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    _, weights = fit(docs)
    return score_documents(docs, weights).select("doc_id", "score", "keep")

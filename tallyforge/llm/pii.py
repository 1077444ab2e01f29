"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the source text. A cascade of transducers then rewrites homoglyphs, zero-width
characters, spelled digits and at/dot disguises; every character it emits carries the span of source characters it came
from. Identifiers found in the rewritten text that touch a rewritten place are mapped back to source spans and added.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .shared import table

#: Kinds in the order of the digest, and the plain forms.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The runs of digits before the first part can only match from their start, so no other place is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: each holds one @ and begins with the run of local characters before it, after the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[Span]:
    """All plain identifiers by kind, then start; code points, end exclusive. Matches that fail their test are dropped."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


# ---- transducers -----------------------------------------------------------------------------------------------------

#: Look-alikes of Latin letters in other scripts.
_LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονɡı", "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXovgi", strict=True))


def _homoglyphs() -> dict[str, str]:
    """Compatibility forms of one ASCII character, digits of all scripts, look-alikes; zero-width characters go."""
    table: dict[str, str] = {}
    for lo, hi in ((0xB2, 0xBA), (0x660, 0x66A), (0x6F0, 0x6FA), (0x966, 0x970), (0x2070, 0x208A), (0x2460, 0x2469), (0x24B6, 0x24EA), (0xFE52, 0xFE6C), (0xFF01, 0xFF5F), (0x1D400, 0x1D800)):
        for c in map(chr, range(lo, hi)):
            form = unicodedata.normalize("NFKC", c)
            digit = unicodedata.digit(c, None)
            if digit is not None:
                table[c] = str(digit)
            elif len(form) == 1 and "!" <= form <= "~":
                table[c] = form
    return table | _LOOKALIKES | dict.fromkeys("​‌‍⁠﻿­", "") | dict.fromkeys("‐‑‒–−", "-")


HOMOGLYPHS = _homoglyphs()
_GLYPHS = frozenset(HOMOGLYPHS)
_GLYPH = re.compile("[" + "".join(map(re.escape, sorted(HOMOGLYPHS))) + "]")

#: The digits' names in English, French, German and Spanish.
_NAMES = [
    "zero oh null zéro cero", "one un eins uno", "two deux zwei zwo dos", "three trois drei tres", "four quatre vier cuatro",
    "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
]
DIGITS = {name: str(d) for d, names in enumerate(_NAMES) for name in names.split()}
_NAME = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_GAP = r"[\s,.\-]{1,3}"
_POINT = r"(?:dot|point|punkt|punto)"
#: A run of digits in words (figures between them are allowed), perhaps with a spelled plus or dots; the identifiers' own
#: tests say whether it is one.
_SPELLED = re.compile(rf"(?i)(?<!\w)(?:(?:plus|más){_GAP})?(?:(?:{_NAME}|[0-9]+){_GAP}(?:{_POINT}{_GAP})?){{3,}}(?:{_NAME}|[0-9]+)(?!\w)")
_SPELLED_NAME = re.compile(rf"(?i){_NAME}")
_SPELLED_TOKEN = re.compile(rf"(?i)(?P<name>{_NAME})(?!\w)|(?P<plus>plus|más)(?!\w)|(?P<dot>{_POINT})(?!\w)|(?P<figure>[0-9]+)")
#: Without the white space before it, which ``_addresses`` adds: a pattern that begins with it would be tried at every blank.
_BRACKETED = re.compile(r"(?i)[\[({<]\s*(?:(?P<at>at|@|arroba)|(?P<dot>dot|point|punkt|punto|\.))\s*[\])}>]\s*")
#: A bare "at" or "dot" counts only where both stand in the place an address has them.
_BARE = re.compile(
    rf"(?i)(?<=[a-z0-9])\s+(?:at|arroba)\s+(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\s+{_POINT}\s+[a-z])"
    rf"|(?<=[a-z0-9])\s+{_POINT}\s+(?=[a-z0-9])"
)
_MARK = re.compile(r"(?i)[\[({<]\s*(?:at|dot|point|punkt|punto|arroba|@|\.)\s*[\])}>]|(?<!\w)(?:at|arroba)\s+\S+\s+(?:dot|point|punkt|punto)\s")

Piece = tuple[int, int, str]  # start and end of what is replaced, and by what


class Mapped:
    """A text with the source span of each of its characters; ``moved`` marks characters a transducer has touched."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end, self.moved = text, range(len(text)), range(1, len(text) + 1), bytes(len(text))

    def rewrite(self, pieces: list[Piece]) -> Mapped:
        """Replace spans of this text. Each emitted character takes the whole replaced source span; where nothing is
        emitted, the characters beside it count as touched."""
        text, start, end, moved, at = [], [], [], bytearray(), 0
        touch = False
        for a, b, new in [*pieces, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            end.extend(self.end[at:a])
            first = len(moved)
            moved += self.moved[at:a]
            if touch and len(moved) > first:
                moved[first] = 1
            if a < b:
                text.append(new)
                start.extend([self.start[a]] * len(new))
                end.extend([self.end[b - 1]] * len(new))
                if not new and moved:
                    moved[-1] = 1
                moved += b"\1" * len(new)
            touch = a < b and not new
            at = b
        out = Mapped("")
        out.text, out.start, out.end, out.moved = "".join(text), start, end, bytes(moved)
        return out


def _spelled(text: str) -> list[Piece]:
    out: list[Piece] = []
    for run in _SPELLED.finditer(text):
        if not _SPELLED_NAME.search(text, *run.span()):
            continue
        tokens = list(_SPELLED_TOKEN.finditer(text, *run.span()))
        if sum(t.lastgroup == "name" for t in tokens) < 2:
            continue
        for t, after in zip(tokens, [*tokens[1:], None], strict=True):  # a token takes the gap behind it
            to = after.start() if after else t.end()
            out.append((t.start(), to, {"name": lambda t=t: DIGITS[t[0].lower()], "plus": lambda: "+", "dot": lambda: ".", "figure": lambda t=t: t[0]}[t.lastgroup]()))
    return out


def _addresses(text: str) -> list[Piece]:
    """Disguised at and dot signs. Bracketed ones count anywhere; a bare dot only in the domain behind an at, or in the local
    part before one, with no other white space between. One pass over the marks in order."""
    marks: list[tuple[int, int, str, bool]] = []
    for m in _BRACKETED.finditer(text):
        a, least = m.start(), marks[-1][1] if marks else 0
        while a > least and text[a - 1].isspace():
            a -= 1
        marks.append((a, m.end(), "@" if m["at"] else ".", True))
    for m in _BARE.finditer(text):
        marks.append((*m.span(), "." if _is_dot(m[0]) else "@", False))
    marks.sort()
    marks = [x for k, x in enumerate(marks) if k == 0 or x[0] >= max(y[1] for y in marks[max(0, k - 2) : k])]
    out: list[Piece] = []
    linked: list[Piece] = []  # bare dots that a name before an at may hold
    end, domain = 0, False  # of the last mark; whether it stands in a domain
    for a, b, sign, bracketed in marks:
        joined = end > 0 and a - end <= 255 and not any(c.isspace() for c in text[end:a])
        if not joined:
            linked, domain = [], False
        if sign == "@":
            out += [*linked, (a, b, "@")]
            linked, domain = [], True
        elif bracketed or domain:
            out.append((a, b, "."))
        else:
            linked.append((a, b, "."))
        end = b
    return sorted(out)


def _is_dot(word: str) -> bool:
    return word.strip().lower() not in ("at", "arroba")


def deobfuscate(text: str) -> Mapped | None:
    """The text after the cascade, or None where no transducer found anything to rewrite."""
    m = Mapped(text)
    if not text.isascii() and not _GLYPHS.isdisjoint(text):
        glyphs = [(x.start(), x.end(), HOMOGLYPHS[x[0]]) for x in _GLYPH.finditer(text)]
        if glyphs:
            m = m.rewrite(glyphs)
    if spelled := _spelled(m.text):
        m = m.rewrite(spelled)
    if _MARK.search(m.text) and (disguised := _addresses(m.text)):
        m = m.rewrite(disguised)
    return m if any(m.moved) or len(m.text) != len(text) else None


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Plain spans, and all spans: plain ones, and those that only the rewritten text shows, each by kind, then start.

    A mapped span is added unless a plain one of its kind covers it.
    """
    plain = plain_spans(text)
    m = deobfuscate(text)
    if m is None:
        return plain, plain
    found = set(plain)
    starts = {kind: [x for k, x, _ in plain if k == kind] for kind in KINDS}  # plain spans of a kind don't overlap
    ends = {kind: [x for k, _, x in plain if k == kind] for kind in KINDS}
    for kind, a, b in plain_spans(m.text):
        if 1 in m.moved[a:b]:
            span = kind, m.start[a], m.end[b - 1]
            at = bisect_right(starts[kind], span[1]) - 1
            if at < 0 or ends[kind][at] < span[2]:
                found.add(span)
    return plain, sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named by the first."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out.append(text[at:s])
            out.append(f"[{kind.upper()}]")
        at = max(at, e)
    out.append(text[at:])
    return "".join(out)


def find_pii(documents: DataFrame, masked: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (plain ones), base (their spans), spans (all) and masked of every row.

    masked: without, that column is null and no text comes back. A null text counts as empty (masked stays null): no spans, empty strings. Repeated rows stay; other columns go.
    """
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()), ("spans", pa.string()), ("masked", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(i: int | None, text: str | None) -> tuple:
            plain, every = all_spans(text or "")
            counts = [sum(s[0] == k for s in plain) for k in KINDS]
            return i, *counts, digest(plain), digest(every), mask(text, every) if masked and text else text if masked else None

        rows = (row(i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        yield from bpe.in_batches(rows, schema, lambda r: 64 + len(r[6]) + 2 * len(r[7] or ""))

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, masked string"
    )


def mask_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with text masked and n_chars, where there is such a column, counted anew; all other columns as they are."""
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        for b in batches:
            texts = [t and mask(t, all_spans(t)[1]) for t in b.column(at).to_pylist()]
            columns = [pa.array(texts, b.schema.field(k).type) if k == at else c for k, c in enumerate(b.columns)]
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(k).type)
            yield pa.record_batch(columns, schema=b.schema)

    return documents.mapInArrow(run, documents.schema)


def op4_offset_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"), masked=False)
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

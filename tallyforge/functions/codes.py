"""Dictionary codes and their bit slices as column expressions. Code 0 stands for unknown, 1 for NULL, 2 on for values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK, NULL, FIRST = 0, 1, 2


@dataclass(frozen=True)
class Slice:
    """A bit slice of a code; slice 0 holds the lowest bits."""

    index: int
    offset: int
    width: int

    @property
    def size(self) -> int:
        """Values of the sliced column, code 0 for unknown included."""
        return (1 << self.width) + 1


def factorize(domain: int, threshold: int = 16) -> list[Slice]:
    """Slices of codes 0 to domain - 1: one where they fit into ``threshold`` bits, else as few as do, near equal,
    the lowest taking what is left over."""
    bits = max(1, (domain - 1).bit_length())
    if domain <= 1 << threshold:
        return [Slice(0, 0, bits)]
    n = -(-bits // threshold)
    each = bits // n
    widths = [bits - each * (n - 1)] + [each] * (n - 1)
    return [Slice(i, sum(widths[:i]), w) for i, w in enumerate(widths)]


def slice_code(code: Column, s: Slice) -> Column:
    """The sliced value plus 1, so that 0 stays free for unknown."""
    return F.shiftright(code, s.offset).bitwiseAND(F.lit((1 << s.width) - 1)) + 1


def join_slices(parts: list[Column], slices: list[Slice]) -> Column:
    """The code that ``slice_code`` cut."""
    out = F.lit(0).cast("long")
    for c, s in zip(parts, slices, strict=True):
        out = out.bitwiseOR(F.shiftleft((c - 1).cast("long"), s.offset))
    return out


def log_fanout(c: Column, epsilon: float = 1e-6) -> Column:
    """log2 of a fanout of 1 or more, with a small positive value for 1."""
    return F.when(c <= 1, F.lit(epsilon)).otherwise(F.log2(c.cast("double")))


def from_log_fanout(c: Column) -> Column:
    return F.greatest(F.pow(F.lit(2.0), c), F.lit(1.0))

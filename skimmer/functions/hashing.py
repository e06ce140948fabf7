"""Seeded hashes of columns, as codegen'd expressions.

``portable`` takes 60 bits of an MD5, so that another engine can repeat every bit;
``fast`` is XXH64; ``clumping`` is a bad hash (the sum of the bytes) kept to show what
the diagnostics catch.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BACKENDS = ("portable", "fast", "clumping")
BITS = {"portable": 60, "fast": 64, "clumping": 64}

#: A pluggable hasher: value column and seed to a BIGINT column.
HashFunction = Callable[[Column, int], Column]


def canonical(c: Column | str, type_: str = "string") -> Column:
    """The text that stands for a value: booleans and integers as BIGINT, bytes as UTF-8, others as strings; null as "None"."""
    c = F.col(c) if isinstance(c, str) else c
    if type_ in ("boolean", "tinyint", "smallint", "int", "bigint"):
        c = c.cast("bigint")
    elif type_ == "binary":
        c = F.decode(c, "UTF-8")
    return F.coalesce(c.cast("string"), F.lit("None"))


def item(df: DataFrame, *names: str) -> Column:
    """The canonical text of one column, or of several joined by a unit separator."""
    types = dict(df.dtypes)
    parts = [canonical(n, types[n]) for n in names]
    return parts[0] if len(parts) == 1 else F.concat_ws("\x1f", *parts)


def _hex(c: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(c, first, digits), 16, 10).cast("bigint")


def clumping(text: Column, seed: int = 0) -> Column:
    """The sum of the UTF-8 bytes; it ignores the seed. Empty: 0."""
    b = F.encode(text, "UTF-8")
    codes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda i: i <= F.length(b)), lambda i: F.conv(F.hex(F.substr(b, i, F.lit(1))), 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x)


@dataclass(frozen=True)
class Hasher:
    backend: str = "portable"
    seed: int = 0

    def __post_init__(self) -> None:
        if self.backend not in BACKENDS:
            raise ValueError(f"unknown backend {self.backend!r}; one of {', '.join(BACKENDS)}")

    @property
    def bits(self) -> int:
        return BITS[self.backend]

    def h(self, text: Column) -> Column:
        """The hash of a text: 60 bits (portable) or all 64 as a signed BIGINT."""
        if self.backend == "fast":
            return F.xxhash64(F.lit(self.seed), text)
        if self.backend == "clumping":
            return clumping(text)
        return _hex(F.md5(F.concat(F.lit(f"{self.seed}:"), text)), 1, 15)

    def pair(self, text: Column) -> tuple[Column, Column]:
        """Two hashes for double hashing, the second odd; one MD5 serves both."""
        if self.backend != "portable":
            first = self.h(text)
            return first, F.xxhash64(first).bitwiseOR(F.lit(1))
        digest = F.md5(F.concat(F.lit(f"{self.seed}:"), text))
        return _hex(digest, 1, 15), _hex(digest, 16, 15).bitwiseOR(F.lit(1))

    def indices(self, text: Column, k: int, m: int) -> Column:
        """ARRAY of k indices below m: (h1 + i h2) mod m in reduced form, which can't overflow."""
        if k < 1:
            raise ValueError("k must be at least 1")
        h1, h2 = self.pair(text)
        a, b = F.pmod(h1, F.lit(m)), F.pmod(h2, F.lit(m))
        return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.pmod(a + i.cast("bigint") * b, F.lit(m)))

    def slot(self, text: Column, capacity: int | Column) -> Column:
        return F.pmod(self.h(text), capacity if isinstance(capacity, Column) else F.lit(capacity))


def exploded_indices(df: DataFrame, text: Column, hasher: Hasher, k: int, m: int, *keep: str, index: str = "idx", row: str = "row") -> DataFrame:
    """One row an item and index: keep..., row (0..k-1), idx. The pair is computed once, before the explode."""
    h1, h2 = hasher.pair(text)
    both = df.select(*keep, F.struct(F.pmod(h1, F.lit(m)).alias("a"), F.pmod(h2, F.lit(m)).alias("b")).alias("__p"))
    return both.select(*keep, "__p", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(row)).select(*keep, row, F.pmod(F.col("__p.a") + F.col(row) * F.col("__p.b"), F.lit(m)).alias(index))


def leading_zeros(c: Column, width: int = 64) -> Column:
    """Zero bits above the highest set one in a field of width bits; width for zero."""
    if not 1 <= width <= 64:
        raise ValueError("width must be from 1 to 64")
    return F.when(c == 0, F.lit(width)).otherwise(F.lit(width) - F.length(F.bin(c))).cast("int")

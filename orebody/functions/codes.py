"""Expressions on strings and numbers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_mod(text: Column, p: int) -> Column:
    """The number spelled by a text's UTF-8 bytes (big-endian, of any length) modulo p, by Horner's rule; null stays null."""
    digits = F.transform(F.sequence(F.lit(1), F.length(F.hex(text)), F.lit(2)), lambda i: F.conv(F.substring(F.hex(text), i, F.lit(2)), 16, 10).cast("bigint"))
    return F.when(F.length(text) > 0, F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, b: (acc * 256 + b) % p)).when(text.isNotNull(), F.lit(0).cast("bigint"))


def trailing_zeros(v: Column) -> Column:
    """Zero bits at a number's end; null for 0."""
    return F.when(v != 0, F.round(F.log2(v.bitwiseAND(-v).cast("double"))).cast("int"))


def universal_hash(x: Column, a: int, b: int, p: int, m: int | None = None) -> Column:
    h = (F.lit(a) * x + F.lit(b)) % p
    return h % m if m else h


def trim_all(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")

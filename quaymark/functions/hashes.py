"""Hashes with the wrap-around of fixed-width integers, inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap32(c: Column) -> Column:
    """A bigint reduced to a signed 32-bit value."""
    m = F.pmod(c, F.lit(1 << 32))
    return F.when(m >= (1 << 31), m - (1 << 32)).otherwise(m)


def string_hash31(c: Column) -> Column:
    """The polynomial hash in 31 over UTF-16 code units (characters of the basic plane), as a signed 32-bit value in a bigint."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), F.lit(0).cast("bigint"), lambda acc, i: F.when(F.length(c) == 0, acc).otherwise(wrap32(acc * 31 + F.ascii(F.substr(c, i, F.lit(1))))))


def sampled(c: Column, basis_points: int) -> Column:
    """A deterministic sample of keys: basis_points of 10 000."""
    h = wrap32(F.pmod(string_hash31(c), F.lit(1 << 32)) * F.lit(0x9E3779B1 - (1 << 32)))
    return F.pmod(h, F.lit(10000)) < basis_points


def sha_prefix(c: Column, chars: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, chars)

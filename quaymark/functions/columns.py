"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as padding around keys.
PADDING = " \t\r\n\f "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """The text without padding; null where nothing is left."""
    t = F.btrim(col(c).cast("string"), F.lit(PADDING))
    return F.when(t != "", t)


def message_id(c: Column | str) -> Column:
    """Identifiers compare trimmed and in lower case; blank ones are null."""
    return F.lower(trimmed(c))


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (without: UTC)."""
    return F.expr(_micros_sql(c))


def millis_floor(c: Column | str) -> Column:
    """Milliseconds since 1970, cut down."""
    us = _micros_sql(c)
    return F.expr(f"({us} - pmod({us}, 1000L)) div 1000L")


def _ref(c: Column | str) -> str:
    if not isinstance(c, str):
        raise TypeError("a column name is needed")
    return c if c.startswith("`") or "." in c else f"`{c}`"


def _micros_sql(c: Column | str) -> str:
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {_ref(c)})"

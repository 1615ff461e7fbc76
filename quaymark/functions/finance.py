"""Prices and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed(side: Column, quantity: Column) -> Column:
    """Bought positive, sold (also short) negative."""
    return F.when(side == "BUY", quantity).otherwise(-quantity)


def slippage_bps(side: Column, price: Column, mark: Column) -> Column:
    """How much worse than the mark a fill was, in basis points."""
    return signed(side, price - mark) / F.nullif(mark, F.lit(0)) * 10000


def move_pct(now: Column, then: Column) -> Column:
    return (now - then) / F.nullif(then, F.lit(0)) * 100


def quotient(part: Column, whole: Column) -> Column:
    """part / whole of doubles as SQL over IEEE numbers has it: over 0 an infinity, 0 / 0 NaN, never an error; null where either is."""
    return F.when(whole == 0, part * F.pow(whole, F.lit(-1.0))).otherwise(part / whole)

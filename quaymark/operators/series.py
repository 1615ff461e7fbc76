"""Time series: bars, running sums, rates, lifetimes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bars(df: DataFrame, by: Sequence[str], start: Column, at: Sequence[Column], price: Column, size: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Open, high, low, close, volume, vwap and count per key and bar. `at` orders the rows totally."""
    o = F.struct(*[a.alias(f"o{i}") for i, a in enumerate(at)])
    d = df.select(*by, start.alias("bar_start"), o.alias("__o"), price.alias("__p"), size.alias("__s"), *[c.alias(n) for n, c in (extra or {}).items()])
    return d.groupBy(*by, "bar_start").agg(
        F.min_by("__p", "__o").alias("open"), F.max("__p").alias("high"), F.min("__p").alias("low"), F.max_by("__p", "__o").alias("close"),
        F.sum("__s").alias("volume"), vwap(F.col("__p"), F.col("__s")).alias("vwap"), F.count(F.lit(1)).alias("n"),
    )


def trade_bars(ticks: DataFrame, symbol: str, start: Column, at: Sequence[Column], mid: Column, last: Column, last_size: Column) -> DataFrame:
    """Minute bars of ticks: prices from trades where the bar has any, else from mids; vwap half-even to six places, null without volume."""
    o = F.struct(*[a.alias(f"o{i}") for i, a in enumerate(at)])
    traded = last_size > 0
    d = ticks.select(F.col(symbol).alias("symbol"), start.alias("bar_start"), o.alias("__o"), mid.alias("__m"), F.when(traded, last).alias("__l"), F.when(traded, last_size).alias("__s"))
    on_trade = F.when(F.col("__l").isNotNull(), F.col("__o"))
    pick = lambda f, p: F.coalesce(f("__l", on_trade), p)
    return d.groupBy("symbol", "bar_start").agg(
        pick(F.min_by, F.min_by("__m", "__o")).alias("open"), F.coalesce(F.max("__l"), F.max("__m")).alias("high"), F.coalesce(F.min("__l"), F.min("__m")).alias("low"), pick(F.max_by, F.max_by("__m", "__o")).alias("close"),
        F.coalesce(F.sum("__s"), F.lit(0)).alias("volume"), F.sum(F.col("__l") * F.col("__s")).alias("notional"), F.bround(F.sum(F.col("__l") * F.col("__s")) / F.nullif(F.sum("__s"), F.lit(0)), 6).alias("vwap"), F.count("__s").alias("trades"), F.count(F.lit(1)).alias("ticks"),
    )


def vwap(price: Column, size: Column) -> Column:
    """Sum of price times size by size; null without size."""
    return F.sum(price * size) / F.nullif(F.sum(size), F.lit(0))


#: Width of a block of time in microseconds: an hour.
BLOCK_US = 3_600_000_000

#: How a running figure of a block and that of all blocks before it go together.
_JOINED = {"sum": lambda now, was: F.coalesce(was, F.lit(0)) + F.coalesce(now, F.lit(0)), "count": lambda now, was: F.coalesce(was, F.lit(0)) + now, "max": F.greatest, "min": F.least}


def _block(c: Column, width: int) -> Column:
    return F.floor(c / F.lit(width)).cast("bigint")


def running(df: DataFrame, by: Sequence[str], at: Column, order: Sequence[Column], figures: dict[str, tuple[str, Column]], *, width: int = BLOCK_US, own: bool = True) -> DataFrame:
    """df with running figures (name: (sum, count, max or min, value)) per key along (at, order), the row itself included or (own=False) not.

    Blocks of `at` are run through each by itself; totals of the blocks before are added. A row without `at` comes before all others.
    """
    o = F.struct(at.alias("a"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    d = df.withColumn("__b", F.coalesce(_block(at, width), F.lit(-(2**62)))).withColumn("__o", o)
    w = Window.partitionBy(*by, "__b").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    f = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    d = d.withColumns({f"__n_{n}": f[k](v).over(w) for n, (k, v) in figures.items()})
    totals = d.groupBy(*by, "__b").agg(*[f[k](v).alias(f"__t_{n}") for n, (k, v) in figures.items()])
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    again = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    prior = totals.select(*by, "__b", *[again[k](f"__t_{n}").over(before).alias(f"__p_{n}") for n, (k, _) in figures.items()])
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "__b")]
    j = d.alias("x").join(prior.alias("y"), same)
    return j.select(*[F.col(f"x.`{c}`") for c in df.columns], *[_JOINED[k](F.col(f"__n_{n}"), F.col(f"__p_{n}")).alias(n) for n, (k, _) in figures.items()])


def trailing(df: DataFrame, by: Sequence[str], us: Column, width_us: int, figures: dict[str, Column]) -> DataFrame:
    """df with sums (name: value) over the rows of the key whose time is within width_us before the row's, rows of the same time included. Rows without time have no figures.

    Each row is sent to its own block of time and to the next, so a block holds all its rows look back to.
    """
    d = df.withColumn("__us", us)
    block = _block(F.col("__us"), max(width_us, 1))
    halo = d.withColumn("__b", F.explode(F.when(F.col("__us").isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.array(block, block + 1))))
    w = Window.partitionBy(*by, "__b").orderBy("__us").rangeBetween(-width_us, 0)
    out = halo.withColumns({n: F.sum(v).over(w) for n, v in figures.items()})
    return out.where(F.col("__b").isNull() | (F.col("__b") == block)).select(*df.columns, *[F.when(F.col("__us").isNotNull(), F.col(n)).alias(n) for n in figures])


def lifetimes(df: DataFrame, by: Sequence[str], us: Column, is_start: Column, is_end: Column, tie: Sequence[Column] = (), width: int = BLOCK_US) -> DataFrame:
    """(by..., started_us, ended_us): each start with the first end at or after it, before the next start.

    Blocks of time are cut into segments each by itself; a segment left open at a block's end is closed
    by an end with which the key's next block begins.
    """
    d = df.select(*by, us.alias("__us"), is_start.alias("__s"), is_end.alias("__e"), *[t.alias(f"__t{i}") for i, t in enumerate(tie)]).where("(__s or __e) and __us is not null")
    d = d.withColumn("__b", _block(F.col("__us"), width))
    w = Window.partitionBy(*by, "__b").orderBy("__us", *[f"__t{i}" for i in range(len(tie))])
    d = d.withColumn("__seg", F.sum(F.when(F.col("__s"), 1).otherwise(0)).over(w))
    segs = d.groupBy(*by, "__b", "__seg").agg(F.min(F.when(F.col("__s"), F.col("__us"))).alias("started_us"), F.min(F.when(F.col("__e"), F.col("__us"))).alias("ended_us"))
    blocks = segs.groupBy(*by, "__b").agg(F.max("__seg").alias("__last"), F.min(F.when(F.col("__seg") == 0, F.col("ended_us"))).alias("__first_end"))
    nxt = blocks.select(*by, "__b", F.col("__last").alias("__seg"), F.lead("__first_end").over(Window.partitionBy(*by).orderBy("__b")).alias("__carried"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "__b", "__seg")]
    j = segs.alias("x").join(nxt.where("__carried is not null").alias("y"), same, "left").where("x.__seg > 0")
    return j.select(*[F.col(f"x.`{c}`") for c in by], "started_us", F.coalesce("ended_us", "__carried").alias("ended_us"))


def previous(df: DataFrame, by: Sequence[str], at: Column, row: Column, width: int) -> DataFrame:
    """df with __r, the row's own struct, and __p, that of the row before it in the order of these structs: within blocks of `width`, and for a block's first row the last of the key's block before."""
    d = df.withColumn("__b", _block(at, width)).withColumn("__r", row)
    w = Window.partitionBy(*by, "__b").orderBy("__r")
    d = d.withColumn("__p", F.lag("__r").over(w))
    last = d.groupBy(*by, "__b").agg(F.max("__r").alias("__l"))
    prior = last.select(*by, "__b", F.lag("__l").over(Window.partitionBy(*by).orderBy("__b")).alias("__c"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*by, "__b")]
    j = d.alias("x").join(prior.alias("y"), same)
    return j.select(*[F.col(f"x.`{c}`") for c in df.columns], "__r", F.coalesce("__p", "__c").alias("__p"))


def counter_rate(df: DataFrame, by: Sequence[str], sec: Column, value: Column, width: int = 3600) -> DataFrame:
    """df with `rate` per second against the row before: null at the first and after a reset."""
    j = previous(df, by, sec, F.struct(sec.alias("s"), value.alias("v")), width)
    r, p = F.col("__r"), F.col("__p")
    rate = F.when((r["v"] >= p["v"]) & (r["s"] > p["s"]), (r["v"] - p["v"]) / (r["s"] - p["s"]))
    return j.select(*df.columns, rate.alias("rate"))


def counter_base(df: DataFrame, by: Sequence[str], ms: Column, value: Column, window: int, kept: int, apart: int) -> DataFrame:
    """df with `base` (ms, v): the sample of a counter that a rate is taken against.

    That is the first in the window before the row, if it lies `apart` before it, else the oldest
    kept one, else the one before. Samples before a reset (a smaller value than before) are
    forgotten. Times of a key are distinct. Rows meet in blocks of `kept`, with the block before.
    """
    d = previous(df, by, ms, F.struct(ms.alias("ms"), value.alias("v")), kept)
    d = running(d, by, F.col("__r.ms"), [], {"__seg": ("sum", F.when(F.col("__r.v") < F.col("__p.v"), 1).otherwise(0))}, width=kept)
    block = _block(F.col("__r.ms"), kept)
    halo = d.withColumn("__b", F.explode(F.array(block, block + 1)))
    w = Window.partitionBy(*by, "__seg", "__b").orderBy("__r.ms")
    near, old = (F.first("__r").over(w.rangeBetween(-n, 0)) for n in (window, kept))
    before = F.when(~(F.col("__r.v") < F.col("__p.v")), F.col("__p"))
    d = halo.withColumns({"__near": near, "__old": old}).where(F.col("__b") == block)
    base = F.when(F.col("__r.ms") - F.col("__near.ms") >= apart, F.col("__near")).when(F.col("__old.ms") < F.col("__r.ms"), F.col("__old")).otherwise(before)
    return d.select(*df.columns, base.alias("base"))

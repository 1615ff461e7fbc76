"""A market that never was: instruments from a seed, and ticks that are a pure function of seed, symbol and time.

The logarithm of a symbol's price moves from day to day by a pull back to its reference and a random
step, and within a day on a Brownian bridge between the two: halves of the day are displaced at
random, then their halves, down to 2^20 steps. All random numbers are hashes of what they are for,
so any slice of time can be generated by itself, on any executor, with the same outcome.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTORS = ("ENERGY", "FINANCE", "HEALTH", "INDUSTRY", "TECHNOLOGY")
VENUES = ("XALP", "XBET", "XGAM")
DAY_MS = 86_400_000
#: Steps of a day as a power of two, the share by which a day is pulled back, days that a day's level goes back, and how far prices move within a day against from day to day.
BRIDGE_BITS, PULL, WARM_UP, WITHIN = 20, 0.2, 30, 0.7
#: How much the prices of each sector move, as a share of the price a day; ticks of the price below and from 1 on.
VOLATILITY = {"ENERGY": 0.022, "FINANCE": 0.016, "HEALTH": 0.014, "INDUSTRY": 0.018, "TECHNOLOGY": 0.025}
SMALL_TICK, TICK = 0.0001, 0.01


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with wrap-around: neighbouring inputs give unrelated outputs."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) from integers."""
    h = np.uint64(0)
    for p in parts:
        h = mix64(np.asarray(h) ^ mix64(np.asarray(p, np.int64).view(np.uint64) if not np.isscalar(p) else np.array([p], np.int64).view(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def normal(*parts: np.ndarray | int) -> np.ndarray:
    u, v = uniform(*parts, 1), uniform(*parts, 2)
    return np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)


def isin(country: str, number: int) -> str:
    """Twelve characters, the last one the check digit over the letters' values."""
    body = f"{country}{number:09d}"
    digits = "".join(str(int(c, 36)) for c in body)
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n // 10 + n % 10
    return body + str(-total % 10)


def instruments(spark: SparkSession, seed: int, n: int = 50) -> DataFrame:
    k = np.arange(n)
    letters = (mix64(k[:, None] * 8 + np.arange(3) + seed * 1_000_003) % np.uint64(26)).astype(int)
    symbols = ["".join(chr(65 + c) for c in row) + chr(65 + i % 26) + chr(65 + i // 26) for i, row in enumerate(letters)]
    ref = np.round(np.exp(3 + 2 * uniform(seed, k, 7)), 2)
    rows = [(int(i), s, isin("ZZ", int(i)), SECTORS[int(i) % len(SECTORS)], float(p), VENUES[int(i) % len(VENUES)]) for i, s, p in zip(k, symbols, ref)]
    return spark.createDataFrame(rows, "instrument int, symbol string, isin string, sector string, ref_price double, primary_mic string")


def fnv1a(text: str) -> int:
    """64 bits of a text's UTF-8 bytes: xor, then times the prime, byte by byte."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def accounts(spark: SparkSession, seed: int, n: int = 20) -> DataFrame:
    """(account, name, desk, venue): who trades, at which desk, and where by default."""
    k = np.arange(n)
    desk, at = (uniform(seed, k, 31) * 3).astype(int), (uniform(seed, k, 32) * len(VENUES)).astype(int)
    rows = [(f"ACC-{i + 1:03d}", f"Account {i + 1}", ("AGENCY", "PRINCIPAL", "PROGRAM")[d], VENUES[v]) for i, d, v in zip(k.tolist(), desk.tolist(), at.tolist())]
    return spark.createDataFrame(rows, "account string, name string, desk string, venue string")


def venues(spark: SparkSession) -> DataFrame:
    """(venue, open_ms, close_ms): trading hours as milliseconds of the day."""
    rows = [(v, (7 + i) * 3_600_000, (15 + i) * 3_600_000) for i, v in enumerate(VENUES)]
    return spark.createDataFrame(rows, "venue string, open_ms bigint, close_ms bigint")


def bridge(seed: int, instrument: np.ndarray, day: np.ndarray, step: np.ndarray) -> np.ndarray:
    """A Brownian bridge of variance 1 over each instrument's day, at a step of 2^BRIDGE_BITS; 0 at both ends."""
    step = np.asarray(step, np.int64)
    lo, hi = np.zeros_like(step), np.full_like(step, 1 << BRIDGE_BITS)
    a, b = np.zeros(len(step)), np.zeros(len(step))
    while (hi - lo > 1).any():
        mid = (lo + hi) >> 1
        at_mid = (a + b) / 2 + np.sqrt((hi - lo) / (1 << BRIDGE_BITS)) / 2 * normal(seed, instrument, day, mid)
        up = step >= mid
        lo, a = np.where(up, mid, lo), np.where(up, at_mid, a)
        hi, b = np.where(up, hi, mid), np.where(up, b, at_mid)
    return np.where(step == hi, b, a)


def level(seed: int, instrument: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Where a day ends: random steps of WARM_UP days, each pulled back since by PULL a day."""
    return sum((1 - PULL) ** k * normal(seed, instrument, day - k, 101) for k in range(WARM_UP))


def price(seed: int, instrument: np.ndarray, ref: np.ndarray, ms: np.ndarray, vol: np.ndarray | float = 0.02) -> np.ndarray:
    """The mid price at a time, on the grid of ticks."""
    day, rest = np.divmod(np.asarray(ms, np.int64), DAY_MS)
    pairs, back = np.unique(np.stack([np.asarray(instrument, np.int64), day]), axis=1, return_inverse=True)
    back = np.ravel(back)
    was, ends = level(seed, pairs[0], pairs[1] - 1)[back], level(seed, pairs[0], pairs[1])[back]
    z = was + (ends - was) * rest / DAY_MS + WITHIN * bridge(seed, instrument, day, rest * (1 << BRIDGE_BITS) // DAY_MS)
    p = ref * np.exp(vol * z)
    tick = np.where(p < 1, SMALL_TICK, TICK)
    return np.maximum(np.round(np.round(p / tick) * tick, 4), tick)


def ticks(spark: SparkSession, seed: int, start_ms: int, end_ms: int, every_ms: int = 1000, n: int = 50) -> DataFrame:
    """Quotes of every instrument at each step of time from start_ms up to end_ms, with trades on about half of them; seq counts a symbol's steps since 1970."""
    times = spark.range(-(-start_ms // every_ms), -(-end_ms // every_ms)).select(F.col("id").alias("seq"), (F.col("id") * every_ms).alias("ts_millis"))
    d = times.crossJoin(F.broadcast(instruments(spark, seed, n)))  # the universe is a list of n
    vols = dict(VOLATILITY)

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            code, names = pd.factorize(f["symbol"])
            i = np.asarray([fnv1a(s) >> 1 for s in names], np.int64)[code] if len(f) else np.empty(0, np.int64)
            ms = f["ts_millis"].to_numpy(np.int64)
            mid = price(seed, i, f["ref_price"].to_numpy(), ms, f["sector"].map(vols).to_numpy(float))
            half = np.maximum(0.01, np.round(mid * 0.0002 * (1 + uniform(seed, i, ms, 11)), 2))
            traded = uniform(seed, i, ms, 12) < 0.5
            size = (100 * (1 + (uniform(seed, i, ms, 13) * 9).astype(int))).astype(np.int64)
            side = np.where(uniform(seed, i, ms, 14) < 0.5, 1, -1)
            yield pd.DataFrame({"symbol": f["symbol"], "ts_millis": ms, "seq": f["seq"], "bid": np.round(mid - half, 4), "ask": np.round(mid + half, 4), "mid": mid, "last": np.where(traded, np.round(mid + side * half, 4), np.nan), "last_size": np.where(traded, size, 0)})

    out = d.mapInPandas(fill, "symbol string, ts_millis bigint, seq bigint, bid double, ask double, mid double, last double, last_size bigint")
    return out.withColumn("last", F.when(~F.isnan("last"), F.col("last")))


@dataclass
class Clock:
    """Time that runs `speed` times as fast as `wall` (seconds; the machine's by default) and can be paused."""

    start_ms: int
    speed: float = 1.0
    wall: Callable[[], float] = time.monotonic
    _since: float | None = field(default=None, init=False)
    _held: float = field(default=0.0, init=False)

    def __post_init__(self) -> None:
        self._since = self.wall()

    def now(self) -> int:
        return int(self.start_ms + self._held + (0 if self._since is None else (self.wall() - self._since) * 1000 * self.speed))

    def pause(self) -> None:
        self._held, self._since = self.now() - self.start_ms, None

    def resume(self) -> None:
        self._since = self.wall() if self._since is None else self._since

    def set_speed(self, speed: float) -> None:
        running = self._since is not None
        self.pause()
        self.speed = speed
        if running:
            self.resume()


class Feed:
    """The market's ticks as a clock goes on: each call gives those since the last one; a paused clock gives none."""

    def __init__(self, spark: SparkSession, seed: int, clock: Clock, every_ms: int = 1000, n: int = 50) -> None:
        self.spark, self.seed, self.clock, self.every_ms, self.n = spark, seed, clock, every_ms, n
        self.upto = clock.now()

    def next(self) -> DataFrame:
        a, self.upto = self.upto, self.clock.now()
        return ticks(self.spark, self.seed, a, self.upto, self.every_ms, self.n)

"""Typed rows from event envelopes and ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import message_id, trimmed
from quaymark.operators.dedupe import keep_first
from quaymark.sources.tables import table


def arrival_order() -> list[Column]:
    """Ingest time, 0 (unknown) last, then the delivery."""
    return [F.when(F.col("ingest_ts_millis") != 0, F.col("ingest_ts_millis")), F.col("delivery_id")]


def symbol_key(c: Column) -> Column:
    """A symbol without padding, case, venue prefix (XVEN:ABC) or venue suffix (ABC.XVEN)."""
    bare = F.upper(trimmed(c))
    return trimmed(F.substring_index(F.substring_index(bare, ":", -1), ".", 1))


def time_us(text: Column) -> Column:
    """Microseconds since 1970 of a time written in ISO form (without a zone: UTC) or as seconds, milliseconds or microseconds since then."""
    t = F.regexp_replace(trimmed(text), r"\.0+$", "")
    digits = t.rlike(r"^-?\d{1,18}$")
    n = F.when(digits, t).try_cast("bigint")
    size = F.length(F.regexp_replace(t, "^-", ""))
    number = F.when(size <= 11, n * 1_000_000).when(size <= 14, n * 1_000).otherwise(n)
    zoned = F.when(t.rlike(r"(?i)(Z|UTC|GMT|[+-]\d{2}(:?\d{2})?)$") & t.rlike(r"\d:\d"), t).otherwise(F.concat(t, F.lit("Z")))
    full = F.regexp_replace(F.upper(zoned), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(digits, number).otherwise(F.unix_micros(full.try_cast("timestamp")))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per booked fill: event_id, symbol_key, us, price, quantity, side, venue, liquidity, account."""
    env = table(spark, sf_dir, "event_envelope").where("sm_type = 'gen_trading_fill'").select("event_id", "ingest_ts_millis", "delivery_id", "payload")
    once = keep_first(env, message_id("event_id"), arrival_order(), key_name="id").where("id is not null")
    v = F.try_parse_json("payload")
    inner = F.try_variant_get(v, "$", "string")
    body = F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(inner)).otherwise(v)
    get = lambda p: F.try_variant_get("body", f"$.{p}", "string")
    f = once.select(F.col("id").alias("event_id"), body.alias("body"))
    return f.select("event_id", symbol_key(get("symbol")).alias("symbol_key"), time_us(get("ts")).alias("us"), get("price").try_cast("decimal(18,4)").alias("price"), get("quantity").try_cast("bigint").alias("quantity"), get("side").alias("side"), get("venue").alias("venue"), get("liquidity").alias("liquidity"), get("accountId").alias("account"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per symbol and seq: of republished and corrected rows the one with the largest (volume, last, mid)."""
    t = table(spark, sf_dir, "tick")
    rest = [c for c in t.columns if c not in ("symbol", "seq")]
    one = t.groupBy("symbol", "seq").agg(F.max_by(F.struct(*rest), F.struct("volume", "last", "mid", "bid", "ask")).alias("r"))
    return one.select("symbol", "seq", *[F.col(f"r.{c}").alias(c) for c in rest]).withColumn("at", F.timestamp_millis("ts_millis").cast("timestamp_ntz"))

"""Booked fills against the tick nearest in time (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.nearest import nearest_join
from quaymark.sources.envelopes import fills, symbol_key
from quaymark.sources.tables import table

TOLERANCE_MS = 2000


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tick = table(spark, sf_dir, "tick")
    return nearest_join(
        fills(spark, sf_dir), tick, entity=F.col("symbol_key"), at=F.col("us"), right_entity=symbol_key(F.col("symbol")), right_at=F.col("ts_millis") * 1000,
        seq=F.struct(F.col("seq"), F.col("symbol")), tolerance_us=TOLERANCE_MS * 1000,
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("event_id", F.col("match_seq.symbol").alias("symbol"), F.col("match_seq.seq").alias("seq"))


def p2_off_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched fill held against the market: its price against the mid of its tick, in basis points."""
    m = _matched(spark, sf_dir).select("event_id", "price", F.col("match_seq.symbol").alias("symbol"), F.col("match_seq.seq").alias("seq"), ((F.col("us") - F.col("match_at")) / 1000.0).alias("apart_ms"))
    mids = table(spark, sf_dir, "tick").groupBy("symbol", "seq").agg(F.max_by("mid", F.struct("ts_millis", "mid")).alias("mid"))
    j = m.join(mids, ["symbol", "seq"])
    off = F.round((F.col("price").cast("double") - F.col("mid").cast("double")) / F.col("mid").cast("double") * 10000, 3)
    return j.select("event_id", "symbol", "seq", "apart_ms", "price", "mid", off.alias("off_bps"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_off_market)}


P2_SQL = r"""
WITH e AS (SELECT lower(trim(event_id)) AS event_id, payload, row_number() OVER (PARTITION BY lower(trim(event_id)) ORDER BY ingest_ts_millis = 0, ingest_ts_millis, delivery_id) AS rn
           FROM event_envelope WHERE sm_type = 'gen_trading_fill'),
p AS (SELECT event_id, json_extract_string(payload, '$.ts') AS t, upper(trim(json_extract_string(payload, '$.symbol'))) AS s FROM e WHERE rn = 1),
f AS (SELECT event_id, split_part(regexp_replace(s, '^.*:', ''), '.', 1) AS k,
        CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS bigint) * 1000
             ELSE epoch_us(CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN t ELSE t || 'Z' END AS timestamptz)) END AS us FROM p),
k AS (SELECT upper(trim(symbol)) AS k, ts_millis * 1000 AS us, min(seq) AS seq, arg_min(symbol, seq) AS symbol FROM tick GROUP BY 1, 2),
a AS (SELECT f.event_id, k.symbol, k.seq, f.us - k.us AS d FROM f ASOF JOIN k ON f.k = k.k AND f.us >= k.us WHERE f.us IS NOT NULL),
b AS (SELECT f.event_id, k.symbol, k.seq, k.us - f.us AS d FROM f ASOF JOIN k ON f.k = k.k AND f.us <= k.us WHERE f.us IS NOT NULL)
SELECT coalesce(CASE WHEN b.d < a.d THEN b.event_id END, a.event_id, b.event_id) AS event_id,
  CASE WHEN a.d IS NULL OR b.d < a.d THEN b.symbol ELSE a.symbol END AS symbol, CASE WHEN a.d IS NULL OR b.d < a.d THEN b.seq ELSE a.seq END AS seq
FROM a FULL JOIN b USING (event_id) WHERE least(coalesce(a.d, 9e18), coalesce(b.d, 9e18)) <= 2000000
"""


#: The same matches with the fill's price and time, against the mid of the matched tick (of several rows of it the latest, then the highest).
P2_OFF_MARKET_SQL = (
    P2_SQL.replace("SELECT event_id, json_extract_string(payload, '$.ts') AS t,", "SELECT event_id, try_cast(json_extract_string(payload, '$.price') AS decimal(18,4)) AS price, json_extract_string(payload, '$.ts') AS t,")
    .replace("f AS (SELECT event_id,", "f AS (SELECT event_id, price,").replace("SELECT f.event_id, k.symbol, k.seq, f.us - k.us AS d", "SELECT f.event_id, f.price, k.symbol, k.seq, f.us - k.us AS d").replace("SELECT f.event_id, k.symbol, k.seq, k.us - f.us AS d", "SELECT f.event_id, f.price, k.symbol, k.seq, k.us - f.us AS d")
    .replace("b.seq ELSE a.seq END AS seq\nFROM", "b.seq ELSE a.seq END AS seq, CASE WHEN a.d IS NULL OR b.d < a.d THEN -b.d ELSE a.d END / 1000.0 AS apart_ms, coalesce(a.price, b.price) AS price\nFROM")
)
P2_OFF_MARKET_SQL = f"""
WITH m AS ({P2_OFF_MARKET_SQL}), q AS (SELECT symbol, seq, arg_max(mid, struct_pack(a := ts_millis, b := mid)) AS mid FROM tick GROUP BY 1, 2)
SELECT event_id, symbol, seq, CAST(apart_ms AS double) AS apart_ms, price, mid, round((CAST(price AS double) - CAST(mid AS double)) / CAST(mid AS double) * 10000, 3) AS off_bps FROM m JOIN q USING (symbol, seq)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p2_off_market": P2_OFF_MARKET_SQL}

"""Named queries on the domain tables: entities, market data, fills, traces, performance runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import micros
from quaymark.functions.finance import signed, slippage_bps
from quaymark.functions.text import flow_of
from quaymark.operators import ranks, series
from quaymark.operators.asof import asof_join
from quaymark.operators.latest import latest_by
from quaymark.operators.trees import rooted
from quaymark.sources.envelopes import fills, ticks
from quaymark.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _bin(c: Column | str, unit: str) -> Column:
    return F.date_trunc(unit, c).cast("timestamp_ntz")


# -- entities --

_LATEST = """SELECT entity_id, sm_type, state, coalesce(version, 0) AS version, created_at, completed_at, date_diff('millisecond', created_at, completed_at) AS latency_ms
  FROM entity_snapshot WHERE entity_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(version, 0) DESC, published_at DESC, topic_partition DESC, topic_offset DESC) = 1"""


def _millis(c: str) -> Column:
    return F.expr(f"(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) - pmod(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}), 1000L)) div 1000L")


@query(_LATEST)
def snapshots_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "entity_snapshot").where("entity_id is not null").withColumn("version", F.coalesce("version", F.lit(0)).cast("bigint"))
    s = latest_by(s.drop("model_json"), ["entity_id"], [F.col("version"), F.col("published_at"), F.col("topic_partition"), F.col("topic_offset")])
    return s.select("entity_id", "sm_type", "state", "version", "created_at", "completed_at", (_millis("completed_at") - _millis("created_at")).alias("latency_ms"))


@query(f"SELECT sm_type, date_trunc('minute', completed_at) AS minute, count(*) AS n FROM ({_LATEST}) WHERE completed_at IS NOT NULL GROUP BY 1, 2")
def completions_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_latest(spark, sf_dir).where("completed_at is not null").groupBy("sm_type", _bin("completed_at", "minute").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sm_type, state, count(*) AS n FROM ({_LATEST}) GROUP BY 1, 2")
def state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_latest(spark, sf_dir).groupBy("sm_type", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT sm_type, count(latency_ms) AS n, round(avg(latency_ms), 4) AS avg_ms, max(latency_ms) AS max_ms, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[least(count(latency_ms), floor(0.5 * count(latency_ms)) + 1)::int] AS p50, list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL))[least(count(latency_ms), floor(0.95 * count(latency_ms)) + 1)::int] AS p95 FROM ({_LATEST}) WHERE latency_ms IS NOT NULL GROUP BY 1")
def completion_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = snapshots_latest(spark, sf_dir).where("latency_ms is not null").withColumn("latency_ms", F.col("latency_ms").cast("bigint"))
    r = ranks.wide(ranks.at_ranks(s, ["sm_type"], F.col("latency_ms"), [0.5, 0.95], "floor"), ["sm_type"], {0.5: "p50", 0.95: "p95"})
    return r.select("sm_type", "n", F.round("mean", 4).alias("avg_ms"), F.col("largest").alias("max_ms"), "p50", "p95")


_ORDERS = """(SELECT entity_id, state, try_cast(json_extract_string(model_json, '$.total.amount') AS decimal(38,4)) AS amount, json_extract_string(model_json, '$.total.currency') AS currency FROM entity_snapshot
  WHERE entity_id IS NOT NULL AND sm_type = 'order' AND model_json IS NOT NULL AND json_valid(model_json) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY coalesce(version, 0) DESC, published_at DESC, topic_partition DESC, topic_offset DESC) = 1)"""


@query(f"SELECT currency, count(amount) AS n, CAST(round(sum(amount), 4) AS double) AS total, round(avg(CAST(amount AS double)), 6) AS mean FROM {_ORDERS} WHERE state = 'DELIVERED' GROUP BY 1")
def revenue_by_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "entity_snapshot").where("entity_id is not null and sm_type = 'order' and model_json is not null").withColumn("v", F.try_parse_json("model_json")).where("v is not null")
    s = s.select("entity_id", "state", F.coalesce("version", F.lit(0)).alias("version"), "published_at", "topic_partition", "topic_offset", F.try_variant_get("v", "$.total.amount", "string").try_cast("decimal(38,4)").alias("amount"), F.try_variant_get("v", "$.total.currency", "string").alias("currency"))
    s = latest_by(s, ["entity_id"], [F.col("version"), F.col("published_at"), F.col("topic_partition"), F.col("topic_offset")]).where("state = 'DELIVERED'")
    return s.groupBy("currency").agg(F.count("amount").alias("n"), F.sum("amount").cast("double").alias("total"), F.round(F.avg(F.col("amount").cast("double")), 6).alias("mean"))


@query("SELECT workflow_id, sm_type, state, json_extract_string(data, '$.amount.currency') AS currency FROM sm_state WHERE starts_with(workflow_id, 'order:') AND json_extract_string(data, '$.status') = state")
def state_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sm_state").where(F.col("workflow_id").startswith("order:") & (F.get_json_object("data", "$.status") == F.col("state")))
    return s.select("workflow_id", "sm_type", "state", F.get_json_object("data", "$.amount.currency").alias("currency"))


# -- market data --

_TICKS = """(SELECT symbol, seq, r.*, make_timestamp(r.ts_millis * 1000) AS tick_at FROM (SELECT symbol, seq, arg_max(struct_pack(ts_millis := ts_millis, bid := bid, ask := ask, mid := mid, last := last, last_size := last_size, volume := volume, trade_venue := trade_venue), struct_pack(a := volume, b := last, c := mid, d := bid, e := ask)) AS r FROM tick GROUP BY 1, 2))"""


@query(f"SELECT symbol, arg_max(bid, struct_pack(a := ts_millis, b := seq)) AS bid, arg_max(ask, struct_pack(a := ts_millis, b := seq)) AS ask, arg_max(ask - bid, struct_pack(a := ts_millis, b := seq)) AS spread, max(ts_millis) AS ts_millis, count(*) AS ticks FROM {_TICKS} GROUP BY 1")
def quotes_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.struct("ts_millis", "seq")
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("bid", o).alias("bid"), F.max_by("ask", o).alias("ask"), F.max_by(F.col("ask") - F.col("bid"), o).alias("spread"), F.max("ts_millis").alias("ts_millis"), F.count(F.lit(1)).alias("ticks"))


@query(f"SELECT symbol, date_trunc('second', tick_at) AS second, count(*) AS n FROM {_TICKS} GROUP BY 1, 2")
def ticks_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).groupBy("symbol", _bin("at", "second").alias("second")).agg(F.count(F.lit(1)).alias("n"))


def _trade_bars(spark: SparkSession, sf_dir: str, start: Column) -> DataFrame:
    return series.trade_bars(ticks(spark, sf_dir), "symbol", start, [F.col("ts_millis"), F.col("seq")], F.col("mid"), F.col("last"), F.col("last_size"))


_BARS = """SELECT symbol, {start} AS bar_start,
  coalesce(arg_min(last, struct_pack(a := ts_millis, b := seq)) FILTER (last_size > 0 AND last IS NOT NULL), arg_min(mid, struct_pack(a := ts_millis, b := seq))) AS open,
  coalesce(max(last) FILTER (last_size > 0), max(mid)) AS high, coalesce(min(last) FILTER (last_size > 0), min(mid)) AS low,
  coalesce(arg_max(last, struct_pack(a := ts_millis, b := seq)) FILTER (last_size > 0 AND last IS NOT NULL), arg_max(mid, struct_pack(a := ts_millis, b := seq))) AS close,
  coalesce(sum(last_size) FILTER (last_size > 0), 0) AS volume, CAST(sum(last * last_size) FILTER (last_size > 0) AS double) / nullif(sum(last_size) FILTER (last_size > 0), 0) AS vwap,
  count(*) FILTER (last_size > 0) AS trades, count(*) AS ticks FROM """ + _TICKS + " GROUP BY 1, 2"


def _doubled(d: DataFrame) -> DataFrame:
    """The operator's vwap is rounded half-even as decimal, which DuckDB can't say: here it is the plain quotient."""
    return d.withColumn("vwap", F.col("notional").cast("double") / F.nullif(F.col("volume"), F.lit(0))).drop("notional")


@query(_BARS.format(start="date_trunc('minute', tick_at)"))
def bars_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubled(_trade_bars(spark, sf_dir, _bin("at", "minute")))


@query(_BARS.format(start="time_bucket(INTERVAL 5 MINUTE, tick_at)"))
def bars_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubled(_trade_bars(spark, sf_dir, F.window(F.col("at").cast("timestamp"), "5 minutes")["start"].cast("timestamp_ntz")))


@query(f"SELECT symbol, sum(last_size) AS volume, round(CAST(sum(last * last_size) AS double) / nullif(sum(last_size), 0), 4) AS vwap, count(*) AS trades FROM {_TICKS} WHERE last_size > 0 GROUP BY 1")
def vwap_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).where("last_size > 0").groupBy("symbol").agg(F.sum("last_size").alias("volume"), F.round(F.sum(F.col("last") * F.col("last_size")).cast("double") / F.nullif(F.sum("last_size"), F.lit(0)), 4).alias("vwap"), F.count(F.lit(1)).alias("trades"))


@query(f"SELECT symbol, round(avg(CAST(ask - bid AS double)), 6) AS mean_spread, max(ask - bid) AS max_spread, round(avg(CAST(ask - bid AS double) / CAST(mid AS double) * 10000), 4) AS mean_bps FROM {_TICKS} GROUP BY 1")
def spread_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("ask") - F.col("bid")
    return ticks(spark, sf_dir).groupBy("symbol").agg(F.round(F.avg(s.cast("double")), 6).alias("mean_spread"), F.max(s).alias("max_spread"), F.round(F.avg(s.cast("double") / F.col("mid").cast("double") * 10000), 4).alias("mean_bps"))


@query(f"SELECT symbol, seq, sum(last_size) OVER w AS volume_1m, count(*) OVER w AS n FROM {_TICKS} WINDOW w AS (PARTITION BY symbol ORDER BY ts_millis RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)")
def rolling_volume_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.trailing(ticks(spark, sf_dir), ["symbol"], F.col("ts_millis") * 1000, 60_000_000, {"volume_1m": F.col("last_size"), "n": F.lit(1)})
    return d.select("symbol", "seq", "volume_1m", "n")


@query(f"""SELECT symbol, round((CAST(last_mid AS double) - CAST(first_mid AS double)) / CAST(first_mid AS double) * 100, 6) AS move_pct FROM (SELECT symbol, arg_max(mid, struct_pack(a := ts_millis, b := seq)) AS last_mid, arg_min(mid, struct_pack(a := ts_millis, b := seq)) AS first_mid FROM {_TICKS} GROUP BY 1)
  ORDER BY abs(round((CAST(last_mid AS double) - CAST(first_mid AS double)) / CAST(first_mid AS double) * 100, 6)) DESC, symbol LIMIT 5""")
def top_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.struct("ts_millis", "seq")
    m = ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("mid", o).cast("double").alias("l"), F.min_by("mid", o).cast("double").alias("f"))
    return m.select("symbol", F.round((F.col("l") - F.col("f")) / F.col("f") * 100, 6).alias("move_pct")).orderBy(F.abs("move_pct").desc(), "symbol").limit(5)


# -- fills --

_FILLS = r"""(SELECT event_id, split_part(regexp_replace(s, '^.*:', ''), '.', 1) AS symbol, side, price, quantity, venue, liquidity, account,
    CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS bigint) * 1000 ELSE epoch_us(CAST(CASE WHEN regexp_matches(t, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN t ELSE t || 'Z' END AS timestamptz)) END AS us FROM
  (SELECT lower(trim(event_id)) AS event_id, json_extract_string(payload, '$.ts') AS t, upper(trim(json_extract_string(payload, '$.symbol'))) AS s, json_extract_string(payload, '$.side') AS side, try_cast(json_extract_string(payload, '$.price') AS decimal(18,4)) AS price,
     try_cast(json_extract_string(payload, '$.quantity') AS bigint) AS quantity, json_extract_string(payload, '$.venue') AS venue, json_extract_string(payload, '$.liquidity') AS liquidity, json_extract_string(payload, '$.accountId') AS account
   FROM event_envelope WHERE sm_type = 'gen_trading_fill' QUALIFY row_number() OVER (PARTITION BY lower(trim(event_id)) ORDER BY ingest_ts_millis = 0, ingest_ts_millis, delivery_id) = 1))"""
_SLIP = f"""(SELECT f.*, t.mid, t.seq, f.us - t.us AS age_us, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END * (CAST(price AS double) - CAST(mid AS double)) / nullif(CAST(mid AS double), 0) * 10000 AS bps
  FROM {_FILLS} f ASOF JOIN (SELECT symbol, us, max(seq) AS seq, arg_max(mid, seq) AS mid FROM (SELECT symbol, seq, mid, ts_millis * 1000 AS us FROM {_TICKS}) GROUP BY 1, 2) t ON f.symbol = t.symbol AND f.us >= t.us WHERE f.us IS NOT NULL)"""


def _slipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir).withColumnRenamed("symbol_key", "symbol")
    t = ticks(spark, sf_dir).select("symbol", "seq", "mid", (F.col("ts_millis") * 1000).alias("tick_us"))
    j = asof_join(f, t, ["symbol"], F.col("us"), F.col("tick_us"), ["seq", "mid", "tick_us"], how="inner", tie=[F.col("seq")])
    return j.withColumn("bps", slippage_bps(F.col("side"), F.col("price").cast("double"), F.col("mid").cast("double"))).withColumn("age_us", F.col("us") - F.col("tick_us"))


@query(f"SELECT event_id, symbol, side, price, quantity, mid, seq, age_us, round(bps, 6) + 0 AS slippage_bps FROM {_SLIP}")
def fill_slippage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slipped(spark, sf_dir).select("event_id", "symbol", "side", "price", "quantity", "mid", "seq", "age_us", (F.round("bps", 6) + 0).alias("slippage_bps"))


def _slip_by(col: str):  # noqa: ANN202
    sql = f"SELECT {col}, count(*) AS fills, sum(quantity) AS shares, round(avg(bps), 6) + 0 AS mean_bps, round(sum(bps * quantity) / nullif(sum(quantity), 0), 6) + 0 AS weighted_bps FROM {_SLIP} GROUP BY 1"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _slipped(spark, sf_dir).groupBy(col).agg(F.count(F.lit(1)).alias("fills"), F.sum("quantity").alias("shares"), (F.round(F.avg("bps"), 6) + 0).alias("mean_bps"), (F.round(series.vwap(F.col("bps"), F.col("quantity")), 6) + 0).alias("weighted_bps"))

    run.__name__ = f"slippage_by_{col}"
    return query(sql)(run)


for _c in ("venue", "liquidity", "symbol"):
    _slip_by(_c)


@query(f"SELECT symbol, count(*) AS fills, sum(quantity) AS shares, round(CAST(sum(price * quantity) AS double) / nullif(sum(quantity), 0), 4) AS fill_vwap, round(any_value(v), 4) AS market_vwap FROM {_FILLS} LEFT JOIN (SELECT symbol AS ms, CAST(sum(last * last_size) AS double) / nullif(sum(last_size), 0) AS v FROM {_TICKS} WHERE last_size > 0 GROUP BY 1) ON symbol = ms WHERE symbol IS NOT NULL GROUP BY 1")
def fill_vwap_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fills(spark, sf_dir).where("symbol_key is not null").groupBy(F.col("symbol_key").alias("symbol")).agg(F.count(F.lit(1)).alias("fills"), F.sum("quantity").alias("shares"), F.sum(F.col("price") * F.col("quantity")).cast("double").alias("pq"))
    m = ticks(spark, sf_dir).where("last_size > 0").groupBy("symbol").agg((F.sum(F.col("last") * F.col("last_size")).cast("double") / F.sum("last_size")).alias("v"))
    return f.join(m, "symbol", "left").select("symbol", "fills", "shares", F.round(F.col("pq") / F.nullif(F.col("shares"), F.lit(0)), 4).alias("fill_vwap"), F.round("v", 4).alias("market_vwap"))


_POS = f"""(SELECT account, symbol, sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS bought, sum(CASE WHEN side = 'BUY' THEN 0 ELSE quantity END) AS sold, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS net_qty,
  CAST(sum(CASE WHEN side = 'BUY' THEN price * quantity ELSE -price * quantity END) AS double) AS cost FROM {_FILLS} GROUP BY 1, 2)"""
_MARK = f"(SELECT symbol AS ms, CAST(arg_max(mid, struct_pack(a := ts_millis, b := seq)) AS double) AS mark FROM {_TICKS} GROUP BY 1)"


@query(f"SELECT account, symbol, bought, sold, net_qty, round(cost, 4) AS cost, round(cost / nullif(net_qty, 0), 6) AS avg_px, round(net_qty * mark, 4) AS value, round(net_qty * mark - cost, 4) AS pnl FROM {_POS} LEFT JOIN {_MARK} ON symbol = ms")
def fill_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = signed(F.col("side"), F.col("quantity"))
    buy = F.col("side") == "BUY"
    p = fills(spark, sf_dir).groupBy("account", F.col("symbol_key").alias("symbol")).agg(
        F.sum(F.when(buy, F.col("quantity")).otherwise(0)).alias("bought"), F.sum(F.when(buy, 0).otherwise(F.col("quantity"))).alias("sold"), F.sum(q).alias("net_qty"), F.sum(q * F.col("price")).cast("double").alias("cost"))
    m = ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("mid", F.struct("ts_millis", "seq")).cast("double").alias("mark"))
    n, c = F.col("net_qty"), F.col("cost")
    return p.join(m, "symbol", "left").select("account", "symbol", "bought", "sold", "net_qty", F.round(c, 4).alias("cost"), F.round(c / F.nullif(n, F.lit(0)), 6).alias("avg_px"), F.round(n * F.col("mark"), 4).alias("value"), F.round(n * F.col("mark") - c, 4).alias("pnl"))


@query(f"SELECT account, round(sum(net_qty * mark - cost), 2) AS pnl, count(*) AS symbols FROM {_POS} LEFT JOIN {_MARK} ON symbol = ms GROUP BY 1")
def pnl_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_positions(spark, sf_dir).groupBy("account").agg(F.round(F.sum("pnl"), 2).alias("pnl"), F.count(F.lit(1)).alias("symbols"))


# -- messages and traces --


@query("SELECT status, count(*) AS n, count(DISTINCT event_id) AS events FROM processed_event GROUP BY 1")
def dedupe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "processed_event").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"))


@query("""SELECT delivery_id, list_sort(list_distinct(CASE WHEN style = 'event' THEN CASE WHEN len(lock_keys) = 0 THEN [sm_type || ':' || event_id] ELSE lock_keys END ELSE list_append(lock_keys, sm_type || ':' || instance_key) END)) AS keys FROM event_envelope""")
def effective_lock_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys an event holds, sorted: an entity's own besides those declared; an event without any has one of its own."""
    own = F.concat_ws(":", "sm_type", "instance_key")
    alone = F.array(F.concat_ws(":", "sm_type", "event_id"))
    k = F.when(F.col("style") == "event", F.when(F.size("lock_keys") == 0, alone).otherwise(F.col("lock_keys"))).otherwise(F.array_append("lock_keys", own))
    return table(spark, sf_dir, "event_envelope").select("delivery_id", F.array_sort(F.array_distinct(k)).alias("keys"))


_TRACE = "(SELECT trace_id, any_value(event_id) AS event_id, any_value(ts) AS ts, any_value(stage) AS stage, any_value(workflow_id) AS workflow_id, any_value(detail) AS detail FROM event_trace GROUP BY 1)"
_FLOW = "CASE WHEN coalesce(workflow_id, '') = '' THEN NULL WHEN starts_with(workflow_id, 'evproc:') THEN 'ev:' || split_part(workflow_id, ':', 2) ELSE split_part(workflow_id, ':', 1) END"


def _traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_trace").select("trace_id", "event_id", "ts", "stage", "workflow_id", "detail").dropDuplicates(["trace_id"])


@query(f"SELECT {_FLOW} AS flow, stage, count(*) AS n, count(DISTINCT event_id) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM {_TRACE} GROUP BY 1, 2")
def flow_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir).groupBy(flow_of(F.col("workflow_id")).alias("flow"), "stage").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_STEPS = 30


@query(f"""WITH t AS (SELECT {_FLOW} AS flow, epoch_ms(ts) AS ms, stage FROM {_TRACE}), b AS (SELECT min(ms) AS a, max(ms) AS z FROM t)
  SELECT flow, greatest(0, least({_STEPS - 1}, ((ms - a) * {_STEPS}) // greatest(z - a, 1))) AS bucket, count(*) FILTER (stage = 'RECEIVED') AS received, count(*) FILTER (stage = 'DONE') AS done, count(*) FILTER (stage IN ('FAILED', 'REJECTED', 'DROPPED')) AS errors FROM t, b WHERE flow IS NOT NULL GROUP BY 1, 2""")
def trace_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flow and thirtieth of the covered time: received, done and failed."""
    t = _traces(spark, sf_dir).select(flow_of(F.col("workflow_id")).alias("flow"), _millis("ts").alias("ms"), "stage")
    b = t.agg(F.min("ms").alias("a"), F.max("ms").alias("z"))  # one row
    d = t.where("flow is not null").crossJoin(F.broadcast(b))
    bucket = F.greatest(F.lit(0), F.least(F.lit(_STEPS - 1), F.expr(f"((ms - a) * {_STEPS}) div greatest(z - a, 1)")))
    n = lambda *s: F.count_if(F.col("stage").isin(*s))
    return d.groupBy("flow", bucket.cast("bigint").alias("bucket")).agg(n("RECEIVED").alias("received"), n("DONE").alias("done"), n("FAILED", "REJECTED", "DROPPED").alias("errors"))


@query(f"""WITH t AS (SELECT workflow_id, ts, trace_id, stage FROM {_TRACE} WHERE workflow_id IS NOT NULL AND stage IN ('RECEIVED', 'DONE')),
  s AS (SELECT *, sum(CASE WHEN stage = 'RECEIVED' THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY ts, trace_id) AS seg FROM t)
  SELECT workflow_id, epoch_us(min(ts) FILTER (stage = 'RECEIVED')) AS started_us, epoch_us(min(ts) FILTER (stage = 'DONE')) AS ended_us FROM s WHERE seg > 0 GROUP BY workflow_id, seg""")
def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traces(spark, sf_dir).where("workflow_id is not null")
    return series.lifetimes(t, ["workflow_id"], micros("ts"), F.col("stage") == "RECEIVED", F.col("stage") == "DONE", [F.col("trace_id")])


@query(r"""SELECT stage, count(x) AS n, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.99) AS p99, round(avg(x), 4) AS mean FROM (SELECT stage, try_cast(nullif(regexp_extract(detail, 'e2eMs=(-?[0-9]+)', 1), '') AS double) AS x FROM """ + _TRACE + """) WHERE x IS NOT NULL GROUP BY 1""")
def e2e_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _traces(spark, sf_dir).select("stage", F.nullif(F.regexp_extract("detail", r"e2eMs=(-?[0-9]+)", 1), F.lit("")).try_cast("double").alias("x")).where("x is not null")
    r = ranks.wide(ranks.interpolated(d, ["stage"], F.col("x"), [0.5, 0.99]), ["stage"], {0.5: "p50", 0.99: "p99"})
    return r.select("stage", "n", "p50", "p99", F.round("mean", 4).alias("mean"))


_PIVOT = "(SELECT event_id, min(ts) FILTER (stage = 'RECEIVED') AS received, min(ts) FILTER (stage = 'LOCK_GRANTED') AS granted, min(ts) FILTER (stage = 'TRANSITION') AS moved, min(ts) FILTER (stage = 'DONE') AS done FROM event_trace GROUP BY 1)"


@query(f"""SELECT section, count(*) AS n, round(avg(us), 3) AS mean_us, quantile_cont(us, 0.5) AS p50_us, quantile_cont(us, 0.99) AS p99_us FROM (
  SELECT 'lock' AS section, CAST(epoch_us(granted) - epoch_us(received) AS double) AS us FROM {_PIVOT} UNION ALL SELECT 'apply', CAST(epoch_us(moved) - epoch_us(granted) AS double) FROM {_PIVOT} UNION ALL SELECT 'finish', CAST(epoch_us(done) - epoch_us(moved) AS double) FROM {_PIVOT} UNION ALL SELECT 'total', CAST(epoch_us(done) - epoch_us(received) AS double) FROM {_PIVOT}) WHERE us IS NOT NULL GROUP BY 1""")
def pipeline_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "event_trace").select("event_id", "stage", micros("ts").alias("us"))
    at = lambda s: F.min(F.when(F.col("stage") == s, F.col("us")))
    p = t.groupBy("event_id").agg(at("RECEIVED").alias("r"), at("LOCK_GRANTED").alias("g"), at("TRANSITION").alias("m"), at("DONE").alias("d"))
    part = lambda n, a, b: F.struct(F.lit(n).alias("section"), (F.col(b) - F.col(a)).cast("double").alias("us"))
    s = p.select(F.inline(F.array(part("lock", "r", "g"), part("apply", "g", "m"), part("finish", "m", "d"), part("total", "r", "d")))).where("us is not null")
    r = ranks.wide(ranks.interpolated(s, ["section"], F.col("us"), [0.5, 0.99]), ["section"], {0.5: "p50_us", 0.99: "p99_us"})
    return r.select("section", "n", F.round("mean", 3).alias("mean_us"), "p50_us", "p99_us")


# -- performance runs --

_SAMPLES = "(SELECT DISTINCT * FROM perf_samples)"


@query(f"""SELECT run_id, count(*) AS samples, max(t_sec) AS seconds, round(avg(processed_per_sec) FILTER (loading), 6) AS loaded_rate, max(completed) AS completed, max(errored) AS errored, count(*) FILTER (NOT kafka_up) AS kafka_down,
  min(instances_up) AS least_up, max(lock_waits) AS lock_waits FROM {_SAMPLES} GROUP BY 1""")
def perf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "perf_samples").distinct()
    return s.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"), F.max("t_sec").alias("seconds"), F.round(F.avg(F.when(F.col("loading"), F.col("processed_per_sec"))), 6).alias("loaded_rate"), F.max("completed").alias("completed"),
        F.max("errored").alias("errored"), F.count_if(~F.col("kafka_up")).alias("kafka_down"), F.min("instances_up").alias("least_up"), F.max("lock_waits").alias("lock_waits"),
    )


@query(f"""SELECT run_id, t_sec, completed, CASE WHEN completed >= lag(completed) OVER w AND t_sec > lag(t_sec) OVER w THEN (completed - lag(completed) OVER w) / (t_sec - lag(t_sec) OVER w) END AS rate
  FROM (SELECT run_id, t_sec, max(completed) AS completed FROM {_SAMPLES} GROUP BY 1, 2) WINDOW w AS (PARTITION BY run_id ORDER BY t_sec)""")
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "perf_samples").groupBy("run_id", "t_sec").agg(F.max("completed").alias("completed"))
    return series.counter_rate(s, ["run_id"], F.col("t_sec"), F.col("completed")).select("run_id", "t_sec", "completed", "rate")


@query("SELECT run_id, t_sec, ts FROM perf_samples QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t_sec DESC, ts DESC) = 1")
def last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "perf_samples").select("run_id", "t_sec", "ts"), ["run_id"], [F.col("t_sec"), F.col("ts")])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT lower(trim(event_id)) AS id, lower(trim(parent_event_id)) AS parent FROM event_envelope),
  t(root, id, depth) AS (SELECT id, id, 0 FROM e WHERE parent IS NULL UNION ALL SELECT t.root, e.id, t.depth + 1 FROM t JOIN e ON e.parent = t.id)
  SELECT root, count(*) AS events, max(depth) AS depth FROM t GROUP BY 1""")
def event_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every event without parent: the events it caused, and how deep."""
    k = lambda c: F.lower(F.trim(c))
    e = table(spark, sf_dir, "event_envelope").select(k("event_id").alias("id"), k("parent_event_id").alias("parent")).where("id is not null").distinct()
    return rooted(e, "id", "parent").groupBy("root").agg(F.count(F.lit(1)).alias("events"), F.max("depth").alias("depth"))


@query("""SELECT sm_type, count(*) AS n, count(*) FILTER (r.id IS NULL) AS missing, count(*) FILTER (r.version < s.version) AS stale, count(*) FILTER (r.version > s.version) AS ahead FROM sm_state s LEFT JOIN (SELECT trim(workflow_id, ' ' || chr(9)) AS id, max(version) AS version FROM sm_state_replica GROUP BY 1) r ON s.workflow_id = r.id GROUP BY 1""")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sm_state").select("workflow_id", "sm_type", F.col("version").alias("v"))
    r = table(spark, sf_dir, "sm_state_replica").groupBy(F.btrim("workflow_id", F.lit(" \t")).alias("id")).agg(F.max("version").alias("w"))
    j = s.join(r, s.workflow_id == r.id, "left")
    return j.groupBy("sm_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("missing"), F.count_if(F.col("w") < F.col("v")).alias("stale"), F.count_if(F.col("w") > F.col("v")).alias("ahead"))



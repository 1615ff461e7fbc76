"""The operators on the order and event tables: joins, aggregates, windows, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions.columns import micros
from quaymark.functions.finance import quotient, slippage_bps
from quaymark.functions.text import log_filter, normalized_message
from quaymark.operators import ranks, series
from quaymark.operators.asof import asof_join
from quaymark.operators.latest import first_by, latest_by, versioned_upsert
from quaymark.sources.tables import table

#: A day in microseconds.
_DAY = 86_400_000_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL counterpart."""

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


def _hour(c: str) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


@query("""SELECT n_name, l_returnflag, count(*) AS fills, count(DISTINCT l_orderkey) AS orders, sum(l_quantity) AS shares, round(sum(l_extendedprice), 2) AS notional,
  round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net_notional
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def sector_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    d = l.join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    px = F.col("l_extendedprice")
    return d.groupBy("n_name", "l_returnflag").agg(
        F.count(F.lit(1)).alias("fills"), F.countDistinct("l_orderkey").alias("orders"), F.sum("l_quantity").alias("shares"), F.round(F.sum(px), 2).alias("notional"),
        F.round(F.sum(F.when(F.col("l_returnflag") == "R", -px).otherwise(px)), 2).alias("net_notional"),
    )


@query("SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "ts", "event_type", "value")


@query("SELECT user_id, arg_max(value, ts) AS last_value, arg_min(value, ts) AS first_value, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id")
def latest_quote_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", "ts").alias("last_value"), F.min_by("value", "ts").alias("first_value"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


def _asof(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(buys, views, ["user_id"], micros("ts"), micros("view_ts"), ["view_id", "view_ts", "view_value"], how=how, tie=[F.col("view_id")], bucket_us=86_400_000_000)


_ASOF = """FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF {how} JOIN (SELECT user_id, ts AS view_ts, event_id AS view_id, value AS view_value FROM events WHERE event_type = 'view') v
  ON p.user_id = v.user_id AND p.ts >= v.view_ts"""


@query("SELECT p.event_id, p.user_id, p.ts, p.value, view_id, view_ts, view_value " + _ASOF.format(how="LEFT"))
def asof_purchase_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "left")


@query("""SELECT p.event_id, p.user_id, round(CASE WHEN p.user_id % 2 = 0 THEN (p.value - view_value) ELSE -(p.value - view_value) END / nullif(view_value, 0) * 10000, 8) + 0 AS bps,
  date_diff('microsecond', view_ts, p.ts) AS age_us """ + _ASOF.format(how=""))
def asof_slippage_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _asof(spark, sf_dir, "inner")
    side = F.when(F.col("user_id") % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL"))
    return d.select("event_id", "user_id", (F.round(slippage_bps(side, F.col("value"), F.col("view_value")), 8) + 0).alias("bps"), (micros("ts") - micros("view_ts")).alias("age_us"))


@query("""SELECT p.user_id % 10 AS grp, count(*) AS fills, round(sum((p.value - view_value) / nullif(view_value, 0) * 10000 * p.value) / nullif(sum(p.value), 0), 3) AS weighted_bps, round(avg(p.value), 6) AS avg_value
  """ + _ASOF.format(how="") + " GROUP BY 1")
def slippage_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _asof(spark, sf_dir, "inner").withColumn("bps", (F.col("value") - F.col("view_value")) / F.nullif(F.col("view_value"), F.lit(0)) * 10000)
    return d.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.count(F.lit(1)).alias("fills"), F.round(series.vwap(F.col("bps"), F.col("value")), 3).alias("weighted_bps"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""WITH f AS (SELECT user_id, count(*) AS fills, round(avg(value), 8) AS avg_fill, date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS z FROM events WHERE event_type = 'purchase' GROUP BY 1),
  b AS (SELECT user_id, date_trunc('hour', ts) AS h, sum(value) AS v, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2)
  SELECT f.user_id, any_value(fills) AS fills, any_value(avg_fill) AS avg_fill, count(b.h) AS hours, coalesce(sum(n), 0) AS views, round(sum(v) / nullif(sum(n), 0), 8) AS market FROM f LEFT JOIN b ON f.user_id = b.user_id AND b.h BETWEEN f.a AND f.z GROUP BY 1""")
def symbol_vwap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    f = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("fills"), F.round(F.avg("value"), 8).alias("avg_fill"), _hour(F.min("ts")).alias("a"), _hour(F.max("ts")).alias("z"))
    b = e.where("event_type = 'view'").groupBy("user_id", _hour("ts").alias("h")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    j = f.join(b, (f.user_id == b.user_id) & F.col("h").between(F.col("a"), F.col("z")), "left").drop(b.user_id)
    return j.groupBy("user_id").agg(F.first("fills").alias("fills"), F.first("avg_fill").alias("avg_fill"), F.count("h").alias("hours"), F.coalesce(F.sum("n"), F.lit(0)).alias("views"), F.round(F.sum("v") / F.nullif(F.sum("n"), F.lit(0)), 8).alias("market"))


@query("""WITH o AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'signup'), b AS (SELECT user_id, date_trunc('day', ts) AS d, sum(value) AS v, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
  SELECT o.event_id, any_value(o.value) AS arrival, coalesce(sum(n), 0) AS market_n, round(sum(v) / nullif(sum(n), 0), 8) AS market_avg, round((sum(v) / nullif(sum(n), 0) - any_value(o.value)) / any_value(o.value) * 10000, 7) AS shortfall_bps
  FROM o LEFT JOIN b ON o.user_id = b.user_id AND b.d BETWEEN date_trunc('day', o.ts) AND o.ts + INTERVAL 3 DAY GROUP BY 1""")
def vwap_vs_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    o = e.where("event_type = 'signup'").select("event_id", "user_id", "ts", "value")
    b = e.where("event_type <> 'signup'").groupBy(F.col("user_id").alias("u"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n"))
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    j = o.join(b, (F.col("user_id") == F.col("u")) & F.col("d").between(day, F.col("ts") + F.expr("interval 3 days")), "left")
    m = F.sum("v") / F.nullif(F.sum("n"), F.lit(0))
    a = F.first("value", ignorenulls=True)
    return j.groupBy("event_id").agg(a.alias("arrival"), F.coalesce(F.sum("n"), F.lit(0)).alias("market_n"), F.round(m, 8).alias("market_avg"), F.round(quotient(m - a, a) * 10000, 7).alias("shortfall_bps"))


@query("""WITH q AS (SELECT user_id, arg_max(value, ts) AS mark FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id, coalesce(sum(value) FILTER (WHERE event_type = 'purchase'), 0) AS bought, coalesce(sum(value) FILTER (WHERE event_type = 'click'), 0) AS sold FROM events GROUP BY 1)
  SELECT user_id, round(bought, 2) AS bought, round(sold, 2) AS sold, round(bought - sold, 2) AS net, round(bought / nullif(bought + sold, 0), 6) AS bought_share, round((bought - sold) * mark, 2) AS value FROM p JOIN q USING (user_id)""")
def account_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    of = lambda t: F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col("value"))), F.lit(0.0))
    p = e.groupBy("user_id").agg(of("purchase").alias("b"), of("click").alias("s"))
    q = e.where("event_type = 'view'").groupBy("user_id").agg(F.max_by("value", "ts").alias("mark"))
    b, s = F.col("b"), F.col("s")
    return p.join(q, "user_id").select("user_id", F.round(b, 2).alias("bought"), F.round(s, 2).alias("sold"), F.round(b - s, 2).alias("net"), F.round(b / F.nullif(b + s, F.lit(0)), 6).alias("bought_share"), F.round((b - s) * F.col("mark"), 2).alias("value"))


_BARS = """SELECT event_type, {start} AS bar_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(user_id) AS volume, round(sum(value * user_id) / nullif(sum(user_id), 0), 6) AS vwap, count(*) AS n FROM events GROUP BY 1, 2"""


@query(_BARS.format(start="date_trunc('hour', ts)"))
def bars_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.bars(table(spark, sf_dir, "events"), ["event_type"], _hour("ts"), [F.col("ts"), F.col("event_id")], F.col("value"), F.col("user_id")).withColumn("vwap", F.round("vwap", 6))


@query("""WITH b AS (SELECT event_type, date_trunc('hour', ts) AS h, arg_min(value, ts) AS o, max(value) AS hi, min(value) AS lo, arg_max(value, ts) AS c, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT event_type, time_bucket(INTERVAL 6 HOUR, h, TIMESTAMP '2000-01-01') AS bar_start, arg_min(o, h) AS open, max(hi) AS high, min(lo) AS low, arg_max(c, h) AS close, sum(n) AS n FROM b GROUP BY 1, 2""")
def bars_6h_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars_ohlcv(spark, sf_dir)
    six = F.window(F.col("bar_start").cast("timestamp"), "6 hours")["start"].cast("timestamp_ntz")
    return b.groupBy("event_type", six.alias("six")).agg(F.min_by("open", "bar_start").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_start").alias("close"), F.sum("n").alias("n")).withColumnRenamed("six", "bar_start")


@query("""SELECT event_id, user_id, round(sum(value * event_id) OVER w / nullif(sum(event_id) OVER w, 0), 4) AS rolling_vwap, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def rolling_vwap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = series.trailing(table(spark, sf_dir, "events"), ["user_id"], micros("ts"), 86_400_000_000, {"pq": F.col("value") * F.col("event_id"), "q": F.col("event_id"), "n": F.lit(1)})
    return e.select("event_id", "user_id", F.round(F.col("pq") / F.nullif(F.col("q"), F.lit(0)), 4).alias("rolling_vwap"), "n")


@query("""SELECT c_mktsegment, c_custkey, spent, rn FROM (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS spent, row_number() OVER (PARTITION BY c_mktsegment ORDER BY round(sum(o_totalprice), 2) DESC, c_custkey) AS rn
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) WHERE rn <= 3""")
def top_movers_per_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    spent = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    d = spent.join(c, F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("spent"), "c_custkey")
    return d.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_mktsegment", "c_custkey", "spent", "rn")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def completions_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(_hour("ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def order_state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderstatus, count(*) AS n, round(avg(d), 6) AS avg_days, max(d) AS max_days, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.95) AS p95 FROM (SELECT o_orderstatus, date_diff('day', o_orderdate, l_shipdate) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1""")
def order_completion_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    d = o.join(l, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderstatus", F.datediff("l_shipdate", "o_orderdate").cast("double").alias("d"))
    r = ranks.wide(ranks.interpolated(d, ["o_orderstatus"], F.col("d"), [0.5, 0.95]), ["o_orderstatus"], {0.5: "p50", 0.95: "p95"})
    return r.select("o_orderstatus", "n", F.round("mean", 6).alias("avg_days"), F.col("largest").cast("bigint").alias("max_days"), "p50", "p95")


@query("SELECT event_type, count(*) AS n, list_sort(list(value))[least(count(*), floor(0.5 * count(*)) + 1)::int] AS p50, list_sort(list(value))[least(count(*), floor(0.95 * count(*)) + 1)::int] AS p95 FROM events GROUP BY 1")
def floor_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.wide(ranks.at_ranks(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [0.5, 0.95], "floor"), ["event_type"], {0.5: "p50", 0.95: "p95"}).drop("mean", "largest")


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.wide(ranks.at_ranks(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [0.5, 0.99], "nearest"), ["event_type"], {0.5: "p50", 0.99: "p99"}).drop("mean", "largest")


@query("SELECT c_custkey, c_name, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def natural_join_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    d = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return d.select("c_custkey", "c_name", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT count(DISTINCT o_orderkey) AS entities, count(l_orderkey) AS child_rows, round(count(l_orderkey) / count(DISTINCT o_orderkey), 4) AS per_entity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def rows_per_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    a = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("c"), F.lit(0)).alias("child_rows"))
    return a.withColumn("per_entity", F.round(F.col("child_rows") / F.col("entities"), 4))


@query("SELECT o_orderkey, count(l_orderkey) AS fills, round(sum(l_extendedprice * l_quantity) / nullif(sum(l_quantity), 0), 8) AS vwap FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def orders_with_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("c"), series.vwap(F.col("l_extendedprice"), F.col("l_quantity")).alias("v"))
    return table(spark, sf_dir, "orders").join(f, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("c", F.lit(0)).alias("fills"), F.round("v", 8).alias("vwap"))


@query("SELECT c_mktsegment AS currency, o_orderstatus AS state, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def money_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT c_mktsegment AS currency, o_orderstatus AS state, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY ALL"
    return spark.sql(text, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


@query("SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).alias("id"), F.col(n).alias("name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AND ts >= (SELECT min(ts) - INTERVAL 1 MINUTE FROM events WHERE event_type = 'purchase')")
def semi_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return spark.sql("SELECT event_id, user_id, value FROM {e} WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM {e} WHERE event_type = 'purchase') AND ts >= (SELECT min(ts) - INTERVAL 1 MINUTE FROM {e} WHERE event_type = 'purchase')", e=e)


@query("""SELECT trim(s.workflow_id) AS workflow_id, CASE WHEN r.version IS NULL THEN 'missing' WHEN r.version < s.version THEN 'stale' WHEN r.version > s.version THEN 'ahead' ELSE 'equal' END AS status
  FROM sm_state s LEFT JOIN (SELECT trim(workflow_id, ' ' || chr(9)) AS id, max(version) AS version FROM sm_state_replica GROUP BY 1) r ON trim(s.workflow_id) = r.id""")
def sink_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sm_state").select(F.trim("workflow_id").alias("workflow_id"), F.col("version").alias("v"))
    r = table(spark, sf_dir, "sm_state_replica").groupBy(F.btrim("workflow_id", F.lit(" \t")).alias("id")).agg(F.max("version").alias("w"))
    status = F.when(F.col("w").isNull(), "missing").when(F.col("w") < F.col("v"), "stale").when(F.col("w") > F.col("v"), "ahead").otherwise("equal")
    return s.join(r, s.workflow_id == r.id, "left").select("workflow_id", status.alias("status"))


@query("SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id", "ts")


@query("""WITH stored AS (SELECT workflow_id AS id, state, version FROM sm_state), batch AS (SELECT entity_id AS id, state, version FROM entity_snapshot WHERE entity_id IS NOT NULL AND version IS NOT NULL AND state IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY version DESC, published_at DESC, topic_partition DESC, topic_offset DESC) = 1), fresh AS (SELECT b.* FROM batch b LEFT JOIN stored s USING (id) WHERE s.id IS NULL OR b.version > s.version)
  SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE id NOT IN (SELECT id FROM fresh)""")
def version_guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "sm_state").select(F.col("workflow_id").alias("id"), "state", "version")
    batch = table(spark, sf_dir, "entity_snapshot").where("entity_id is not null and version is not null and state is not null").withColumn("id", F.col("entity_id"))
    return versioned_upsert(stored, batch, "id", "version", F.struct("published_at", "topic_partition", "topic_offset"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS bigint) AS k, json_extract_string(props, '$.missing') AS missing FROM events WHERE json_extract_string(props, '$.k') <> '7'")
def json_extract_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").where(k != "7").select("event_id", k.try_cast("bigint").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query(r"""SELECT trace_id, substring(regexp_replace(regexp_replace(detail, '\b[0-9a-fA-F-]{8,}\b', '…', 'g'), '[0-9]+', '#', 'g'), 1, 160) AS message FROM event_trace WHERE detail IS NOT NULL""")
def message_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_trace").where("detail is not null").select("trace_id", normalized_message(F.col("detail")).alias("message"))


@query(r"""SELECT stage, substring(regexp_replace(regexp_replace(coalesce(detail, ''), '\b[0-9a-fA-F-]{8,}\b', '…', 'g'), '[0-9]+', '#', 'g'), 1, 160) AS message, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen
  FROM event_trace WHERE stage IN ('FAILED', 'REJECTED', 'DROPPED', 'BLOCKED', 'PARKED') GROUP BY 1, 2""")
def failure_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "event_trace").where(F.col("stage").isin("FAILED", "REJECTED", "DROPPED", "BLOCKED", "PARKED"))
    return bad.groupBy("stage", normalized_message(F.coalesce("detail", F.lit(""))).alias("message")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("SELECT trace_id, detail FROM event_trace WHERE contains(detail, 'e2eMs') AND NOT contains(detail, 'srcMs=1') AND (contains(detail, 'e2eMs=3') OR contains(detail, 'done'))")
def log_filter_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_trace").where(log_filter(F.col("detail"), 'e2eMs -"srcMs=1" ?e2eMs=3 ?done')).select("trace_id", "detail")


@query("SELECT trace_id, event_id, stage, detail FROM event_trace WHERE detail LIKE 'handler_error%'")
def errors_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`_` stands for any sign."""
    return table(spark, sf_dir, "event_trace").where(F.col("detail").like("handler_error%")).select("trace_id", "event_id", "stage", "detail")


@query("SELECT event_id, string_agg(k, ' | ' ORDER BY k) AS lock_keys FROM (SELECT event_id, unnest(lock_keys) AS k FROM event_envelope) WHERE k IS NOT NULL GROUP BY event_id")
def lock_keys_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lock keys of all deliveries of an event as one text; events without keys don't come."""
    keys = table(spark, sf_dir, "event_envelope").where("size(lock_keys) > 0").groupBy("event_id").agg(F.array_sort(F.array_compact(F.flatten(F.collect_list("lock_keys")))).alias("k"))
    return keys.where("size(k) > 0").select("event_id", F.array_join("k", " | ").alias("lock_keys"))


@query("SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS double) * x)), 6) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def array_map_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    sq = F.transform("embedding", lambda x: x.cast("double") * x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dim"), F.round(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x), 6).alias("norm2"), F.size(F.filter("embedding", lambda x: x > 0)).alias("positive"))


@query("SELECT delivery_id, generate_subscripts(lock_keys, 1) - 1 AS idx, unnest(lock_keys) AS lock_key FROM event_envelope WHERE len(lock_keys) > 0")
def unnest_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "event_envelope").select("delivery_id", F.posexplode("lock_keys").alias("idx", "lock_key"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM events) WHERE value < top")
def out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.running(table(spark, sf_dir, "events"), ["user_id"], micros("ts"), [F.col("event_id")], {"top": ("max", F.col("value"))}, width=_DAY, own=False)
    return d.where("value < top").select("user_id", "event_id")


@query("SELECT user_id, event_id, row_number() OVER w AS seq, round(sum(value) OVER w, 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def running_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.running(table(spark, sf_dir, "events"), ["user_id"], micros("ts"), [F.col("event_id")], {"seq": ("count", F.lit(1)), "total": ("sum", F.col("value"))}, width=_DAY)
    return d.select("user_id", "event_id", "seq", F.round("total", 4).alias("running"))


@query("SELECT o_orderkey, o_totalprice, abs(o_totalprice - 100000) AS far FROM orders ORDER BY abs(o_totalprice - 100000) DESC, o_orderkey LIMIT 20")
def head_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.abs(F.col("o_totalprice") - 100000)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", far.alias("far")).orderBy(F.desc("far"), "o_orderkey").limit(20)


@query("""WITH e AS (SELECT DISTINCT lower(trim(event_id)) AS id, lower(trim(parent_event_id)) AS parent, lower(trim(causation_root)) AS root FROM event_envelope)
  SELECT id, parent, root, len(id) - len(regexp_replace(id, '(\\.[0-9]+)+$', '')) AS tail, CASE WHEN regexp_matches(id, '(\\.[0-9]+)+$') THEN len(regexp_extract(id, '((\\.[0-9]+)+)$', 1)) - len(replace(regexp_extract(id, '((\\.[0-9]+)+)$', 1), '.', '')) ELSE 0 END AS depth FROM e""".replace("\\\\", "\\"))
def causation_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quaymark.functions.text import causation_depth

    k = lambda c: F.lower(F.trim(c))
    e = table(spark, sf_dir, "event_envelope").select(k("event_id").alias("id"), k("parent_event_id").alias("parent"), k("causation_root").alias("root")).distinct()
    return e.select("id", "parent", "root", F.length(F.regexp_extract("id", r"((?:\.[0-9]+)*)$", 1)).cast("bigint").alias("tail"), causation_depth(F.col("id")).cast("bigint").alias("depth"))

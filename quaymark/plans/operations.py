"""Named queries about the running system: flows, lag, dead letters, throughput, baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import micros
from quaymark.functions.hashes import string_hash31
from quaymark.functions.text import causation_depth, flow_of
from quaymark.operators import ranks, series
from quaymark.plans.domain import _FLOW, _LATEST, _TICKS, _TRACE, _traces, snapshots_latest
from quaymark.sources.envelopes import ticks
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


#: The moment up to which a reader is taken to have read.
READ_UNTIL = "2025-06-01 00:00:00"


@query(f"""SELECT topic_partition, max(topic_offset) + 1 AS end_offset, coalesce(max(topic_offset) FILTER (published_at <= TIMESTAMP '{READ_UNTIL}') + 1, 0) AS committed,
  greatest(0, max(topic_offset) + 1 - coalesce(max(topic_offset) FILTER (published_at <= TIMESTAMP '{READ_UNTIL}') + 1, 0)) AS lag FROM entity_snapshot GROUP BY 1""")
def partition_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a reader that stands at READ_UNTIL is behind, per partition."""
    read = F.col("published_at") <= F.lit(READ_UNTIL).cast("timestamp_ntz")
    p = table(spark, sf_dir, "entity_snapshot").groupBy("topic_partition").agg((F.max("topic_offset") + 1).alias("end_offset"), F.coalesce(F.max(F.when(read, F.col("topic_offset"))) + 1, F.lit(0)).alias("committed"))
    return p.withColumn("lag", F.greatest(F.lit(0), F.col("end_offset") - F.col("committed")))


@query("""SELECT sm_type, CASE WHEN NOT json_valid(model_json) THEN 'not JSON' WHEN json_type(model_json) <> 'OBJECT' THEN 'not an object' ELSE 'no entity' END AS error, count(*) AS n, max(published_at) AS last_seen
  FROM entity_snapshot WHERE model_json IS NOT NULL AND (NOT json_valid(model_json) OR json_type(CASE WHEN json_valid(model_json) THEN model_json END) <> 'OBJECT' OR entity_id IS NULL) GROUP BY 1, 2""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that can't be stored, by type and reason, with the last time of each."""
    d = table(spark, sf_dir, "entity_snapshot").where("model_json is not null").withColumn("v", F.try_parse_json("model_json"))
    error = F.when(F.col("v").isNull(), "not JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "not an object").when(F.col("entity_id").isNull(), "no entity")
    return d.withColumn("error", error).where("error is not null").groupBy("sm_type", "error").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("last_seen"))


@query(f"SELECT {_FLOW} AS flow, count(DISTINCT event_id) FILTER (stage = 'DONE') AS done, round(count(DISTINCT event_id) FILTER (stage = 'DONE') / greatest(0.001, (epoch_us(max(ts) FILTER (stage = 'DONE')) - epoch_us(min(ts) FILTER (stage = 'RECEIVED'))) / 1e6), 6) AS per_second FROM {_TRACE} WHERE coalesce(workflow_id, '') <> '' GROUP BY 1")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events done per second, from the first received to the last done, per flow."""
    t = _traces(spark, sf_dir).select(flow_of(F.col("workflow_id")).alias("flow"), "event_id", "stage", micros("ts").alias("us")).where("flow is not null")
    done, at = F.col("stage") == "DONE", F.col("us")
    g = t.groupBy("flow").agg(F.countDistinct(F.when(done, F.col("event_id"))).alias("done"), F.max(F.when(done, at)).alias("z"), F.min(F.when(F.col("stage") == "RECEIVED", at)).alias("a"))
    return g.select("flow", "done", F.round(F.col("done") / F.greatest(F.lit(0.001), (F.col("z") - F.col("a")) / 1e6), 6).alias("per_second"))


@query(f"SELECT {_FLOW} AS flow, date_trunc('second', ts) AS second, count(*) AS n FROM {_TRACE} WHERE stage = 'RECEIVED' AND coalesce(workflow_id, '') <> '' GROUP BY 1, 2")
def published_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _traces(spark, sf_dir).where("stage = 'RECEIVED'").withColumn("flow", flow_of(F.col("workflow_id"))).where("flow is not null")
    return t.groupBy("flow", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("second")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT event_id, epoch_us(min(ts) FILTER (stage = 'LOCK_WAIT')) AS a, epoch_us(min(ts) FILTER (stage = 'LOCK_GRANTED')) AS z FROM {_TRACE} GROUP BY 1)
  SELECT count(*) AS n, round(avg((z - a) / 1000.0), 4) AS mean_ms, max(z - a) / 1000.0 AS max_ms, quantile_cont(CAST(z - a AS double), 0.5) AS p50_us FROM w WHERE a IS NOT NULL AND z IS NOT NULL""")
def lock_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.min(F.when(F.col("stage") == s, micros("ts")))
    w = _traces(spark, sf_dir).groupBy("event_id").agg(at("LOCK_WAIT").alias("a"), at("LOCK_GRANTED").alias("z")).where("a is not null and z is not null").withColumn("us", (F.col("z") - F.col("a")).cast("double"))
    r = ranks.wide(ranks.interpolated(w, [], F.col("us"), [0.5]), [], {0.5: "p50_us"})
    return r.select("n", F.round(F.col("mean") / 1000, 4).alias("mean_ms"), (F.col("largest") / 1000).alias("max_ms"), "p50_us")


@query(f"""WITH d AS (SELECT event_id, epoch_us(min(ts) FILTER (stage = 'DONE')) - epoch_us(min(ts) FILTER (stage = 'RECEIVED')) AS us, arg_min(workflow_id, ts) FILTER (stage = 'RECEIVED' AND workflow_id IS NOT NULL) AS w, min(ts) FILTER (stage = 'RECEIVED') AS got FROM {_TRACE} GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY got, event_id) AS rn FROM d WHERE us IS NOT NULL AND w IS NOT NULL) SELECT rn = 1 AS cold, count(*) AS n, round(avg(us / 1000.0), 4) AS mean_ms FROM r GROUP BY 1""")
def cold_and_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finished event of each workflow against the later ones."""
    at = lambda s: F.min(F.when(F.col("stage") == s, micros("ts")))
    got = (F.col("stage") == "RECEIVED") & F.col("workflow_id").isNotNull()
    d = _traces(spark, sf_dir).groupBy("event_id").agg((at("DONE") - at("RECEIVED")).alias("us"), F.min_by(F.when(got, F.col("workflow_id")), F.when(got, micros("ts"))).alias("w"), at("RECEIVED").alias("at")).where("us is not null and w is not null")
    first = d.groupBy(F.col("w").alias("fw")).agg(F.min(F.struct("at", "event_id")).alias("f"))
    j = d.join(first, F.col("w") == F.col("fw")).withColumn("cold", F.col("event_id") == F.col("f.event_id"))
    return j.groupBy("cold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("us") / 1000), 4).alias("mean_ms"))


@query(f"SELECT sm_type, entity_id, state, version FROM ({_LATEST}) WHERE sm_type IN ('order', 'claim') AND state IS NOT NULL")
def orders_and_claims_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots_latest(spark, sf_dir).where(F.col("sm_type").isin("order", "claim") & F.col("state").isNotNull()).select("sm_type", "entity_id", "state", "version")


@query(r"""SELECT sm_type, CASE WHEN regexp_matches(id, '(\.[0-9]+)+$') THEN len(regexp_extract(id, '((\.[0-9]+)+)$', 1)) - len(replace(regexp_extract(id, '((\.[0-9]+)+)$', 1), '.', '')) ELSE 0 END AS depth, count(*) AS n
  FROM (SELECT DISTINCT sm_type, lower(trim(event_id)) AS id FROM event_envelope) GROUP BY 1, 2""")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "event_envelope").select("sm_type", F.lower(F.trim("event_id")).alias("id")).distinct()
    return e.groupBy("sm_type", causation_depth(F.col("id")).cast("bigint").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sm_type, count(*) AS n, count(*) FILTER (scheduled_at_millis > 0) AS scheduled, max(scheduled_at_millis - ingest_ts_millis) FILTER (scheduled_at_millis > 0 AND ingest_ts_millis > 0) AS longest_ms FROM event_envelope GROUP BY 1")
def scheduled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("scheduled_at_millis") > 0
    return table(spark, sf_dir, "event_envelope").groupBy("sm_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(later).alias("scheduled"), F.max(F.when(later & (F.col("ingest_ts_millis") > 0), F.col("scheduled_at_millis") - F.col("ingest_ts_millis"))).alias("longest_ms"))


_HASH = "list_reduce(list_prepend(0::bigint, list_transform(string_split(symbol, ''), lambda c: ascii(c)::bigint)), lambda a, c: ((a * 31 + c + 2147483648) % 4294967296) - 2147483648)"
#: Fixed values of the basket's draw.
BASKET_SEED, BASKET_PCT = 42, 60


@query(f"""WITH q AS (SELECT symbol, CAST(arg_max(mid, struct_pack(a := ts_millis, b := seq)) AS double) AS mid, abs({_HASH} * 2654435761 + {BASKET_SEED} * 40503) AS h FROM {_TICKS} GROUP BY 1)
  SELECT symbol, CASE WHEN (h // 100) % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, 100 * (1 + (h // 1000) % 9) AS quantity, mid, round(100 * (1 + (h // 1000) % 9) * mid, 4) AS notional FROM q WHERE h % 100 < {BASKET_PCT}""")
def basket_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A basket drawn by a hash of the symbol, valued at the latest quotes."""
    q = ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("mid", F.struct("ts_millis", "seq")).cast("double").alias("mid"))
    h = F.abs(string_hash31(F.col("symbol")) * F.lit(2654435761) + F.lit(BASKET_SEED * 40503))
    q = q.withColumn("h", h).where(F.col("h") % 100 < BASKET_PCT)
    size = F.expr("100 * (1 + (h div 1000) % 9)")
    return q.select("symbol", F.when(F.expr("(h div 100) % 2 = 0"), "BUY").otherwise("SELL").alias("side"), size.alias("quantity"), "mid", F.round(size * F.col("mid"), 4).alias("notional"))


_BASKET = SQL["basket_positions"]


@query(f"SELECT side, count(*) AS symbols, round(sum(notional), 2) AS notional FROM ({_BASKET}) GROUP BY 1")
def basket_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basket_positions(spark, sf_dir).groupBy("side").agg(F.count(F.lit(1)).alias("symbols"), F.round(F.sum("notional"), 2).alias("notional"))


@query("""WITH s AS (SELECT DISTINCT * FROM perf_samples), m AS (SELECT run_id, t_sec // 5 AS bucket, count(*) AS marks FROM s WHERE NOT kafka_up GROUP BY 1, 2), b AS (SELECT run_id, t_sec // 5 AS bucket, round(avg(processed_per_sec), 6) AS rate FROM s GROUP BY 1, 2)
  SELECT b.run_id, b.bucket, rate, coalesce(marks, 0) AS marks FROM b LEFT JOIN m ON b.run_id = m.run_id AND b.bucket = m.bucket""")
def marks_over_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's rate in stretches of five seconds, with the number of outage samples in each."""
    s = table(spark, sf_dir, "perf_samples").distinct().withColumn("bucket", F.expr("t_sec div 5"))
    return s.groupBy("run_id", "bucket").agg(F.round(F.avg("processed_per_sec"), 6).alias("rate"), F.count_if(~F.col("kafka_up")).alias("marks"))


@query("""WITH s AS (SELECT DISTINCT * FROM perf_samples) SELECT regexp_extract(run_id, '([a-z]+)$', 1) AS kind, count(DISTINCT run_id) AS runs, median(completed_per_sec) AS median_rate, round(avg(latency_p50) FILTER (loading AND latency_p50 >= 0 AND NOT isnan(latency_p50) AND NOT isinf(latency_p50)), 6) AS mean_p50
  FROM s WHERE completed_per_sec >= 0 AND NOT isnan(completed_per_sec) AND NOT isinf(completed_per_sec) GROUP BY 1""")
def runs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "perf_samples").distinct().withColumn("kind", F.regexp_extract("run_id", "([a-z]+)$", 1)).where("completed_per_sec >= 0 and not isnan(completed_per_sec) and completed_per_sec < double('Infinity')")
    ok = F.col("loading") & (F.col("latency_p50") >= 0) & ~F.isnan("latency_p50") & (F.col("latency_p50") < float("inf"))
    a = s.groupBy("kind").agg(F.countDistinct("run_id").alias("runs"), F.round(F.avg(F.when(ok, F.col("latency_p50"))), 6).alias("mean_p50"))
    return a.join(ranks.wide(ranks.interpolated(s, ["kind"], F.col("completed_per_sec"), [0.5]), ["kind"], {0.5: "median_rate"}).select("kind", "median_rate"), "kind")


@query(f"""SELECT symbol, seq, sum(last_size) OVER w AS traded, row_number() OVER w AS place FROM {_TICKS} WHERE last_size > 0 WINDOW w AS (PARTITION BY symbol ORDER BY ts_millis, seq)""")
def traded_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = series.running(ticks(spark, sf_dir).where("last_size > 0"), ["symbol"], F.col("ts_millis") * 1000, [F.col("seq")], {"traded": ("sum", F.col("last_size")), "place": ("count", F.lit(1))})
    return d.select("symbol", "seq", "traded", "place")

"""Named queries of the live surfaces: entity children with their roots, quotes with instruments, trace windows, rates, checks of completeness, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import micros
from quaymark.functions.hashes import string_hash31
from quaymark.functions.text import flow_of
from quaymark.operators import ranks, series
from quaymark.operators.latest import latest_by
from quaymark.plans.domain import _FLOW, _TICKS, _TRACE, _millis, _traces, fill_positions
from quaymark.plans.domain import SQL as DOMAIN
from quaymark.plans.operations import _HASH, basket_positions
from quaymark.plans.operations import SQL as OPERATIONS
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


# -- children with their roots --

_VERSIONS = """(SELECT entity_id, coalesce(version, 0) AS entity_version, sm_type, state, model_json FROM entity_snapshot
  WHERE entity_id IS NOT NULL AND state IS NOT NULL AND json_valid(model_json) QUALIFY row_number() OVER (PARTITION BY entity_id, coalesce(version, 0) ORDER BY published_at DESC, topic_partition DESC, topic_offset DESC) = 1)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each version of an entity that has readable content."""
    s = table(spark, sf_dir, "entity_snapshot").where("entity_id is not null and state is not null").withColumn("entity_version", F.coalesce("version", F.lit(0)).cast("bigint"))
    s = s.where(F.try_parse_json("model_json").isNotNull())
    return latest_by(s, ["entity_id", "entity_version"], [F.col("published_at"), F.col("topic_partition"), F.col("topic_offset")])


@query(f"""WITH v AS {_VERSIONS}, root AS (SELECT entity_id, max(entity_version) AS entity_version, arg_max(state, entity_version) AS state FROM v WHERE sm_type = 'order' GROUP BY 1),
  child AS (SELECT entity_id, entity_version, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS x FROM (SELECT entity_id, entity_version, json_extract(model_json, '$.lines[*]') AS l FROM v WHERE sm_type = 'order'))
  SELECT c.entity_id, c.entity_version, r.state, c.idx, json_extract_string(x, '$.sku') AS sku, try_cast(json_extract_string(x, '$.quantity') AS bigint) AS quantity FROM child c JOIN root r ON c.entity_id = r.entity_id AND c.entity_version = r.entity_version""")
def lines_with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines beside the state of their order, joined on entity and version: those of the current version."""
    v = _versions(spark, sf_dir).where("sm_type = 'order'")
    root = v.groupBy("entity_id").agg(F.max(F.struct("entity_version", "state")).alias("r")).select("entity_id", "r.*")
    line = F.from_json("model_json", "lines array<struct<sku string, quantity string>>")["lines"]
    child = v.select("entity_id", "entity_version", F.posexplode(line).alias("idx", "x"))
    return child.join(root, ["entity_id", "entity_version"]).select("entity_id", "entity_version", "state", "idx", F.col("x.sku").alias("sku"), F.col("x.quantity").try_cast("bigint").alias("quantity"))


# -- quotes with instruments --

#: The sectors of the instrument list, by the symbol's hash; every seventh symbol isn't on it.
SECTORS = ("ENERGY", "FINANCE", "HEALTH", "INDUSTRY", "TECHNOLOGY")
_SECTOR_SQL = "[" + ", ".join(f"'{s}'" for s in SECTORS) + "]"
_INSTRUMENTS = f"""(SELECT symbol, ({_SECTOR_SQL})[CAST(abs({_HASH}) % 5 AS int) + 1] AS sector, CAST(arg_min(mid, struct_pack(a := ts_millis, b := seq)) AS double) AS ref_price FROM {_TICKS} GROUP BY symbol HAVING abs({_HASH}) % 7 <> 0)"""


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sector, ref_price): the symbols' first mids are their reference prices."""
    h = F.abs(string_hash31(F.col("symbol")))
    sector = F.element_at(F.array(*[F.lit(s) for s in SECTORS]), (h % 5).cast("int") + 1)
    first = ticks(spark, sf_dir).groupBy("symbol").agg(F.min_by("mid", F.struct("ts_millis", "seq")).cast("double").alias("ref_price"))
    return first.where(h % 7 != 0).select("symbol", sector.alias("sector"), "ref_price")


def _move(price: Column, ref: Column) -> Column:
    return F.round((price.cast("double") - ref) / ref * 100, 6)


@query(f"SELECT t.symbol, t.seq, i.sector, round((CAST(t.mid AS double) - i.ref_price) / i.ref_price * 100, 6) AS move_pct FROM {_TICKS} t LEFT JOIN {_INSTRUMENTS} i ON t.symbol = i.symbol")
def ticks_with_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick beside its instrument; ticks of unlisted symbols stay."""
    t = ticks(spark, sf_dir).select("symbol", "seq", "mid")
    return t.join(instruments(spark, sf_dir), "symbol", "left").select("symbol", "seq", "sector", _move(F.col("mid"), F.col("ref_price")).alias("move_pct"))


@query(f"""SELECT sector, count(*) AS symbols, round(avg((CAST(mid AS double) - ref_price) / ref_price * 100), 6) AS avg_move_pct FROM (SELECT symbol, arg_max(mid, struct_pack(a := ts_millis, b := seq)) AS mid FROM {_TICKS} GROUP BY 1) q LEFT JOIN {_INSTRUMENTS} i ON q.symbol = i.symbol GROUP BY 1""")
def sector_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ticks(spark, sf_dir).groupBy("symbol").agg(F.max_by("mid", F.struct("ts_millis", "seq")).cast("double").alias("mid"))
    j = q.join(instruments(spark, sf_dir), "symbol", "left")
    return j.groupBy("sector").agg(F.count(F.lit(1)).alias("symbols"), F.round(F.avg((F.col("mid") - F.col("ref_price")) / F.col("ref_price") * 100), 6).alias("avg_move_pct"))


@query(f"SELECT sector, round(sum(value), 2) AS market_value, round(sum(pnl), 2) AS pnl FROM ({DOMAIN['fill_positions']}) p LEFT JOIN {_INSTRUMENTS} i ON p.symbol = i.symbol GROUP BY 1")
def sector_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = fill_positions(spark, sf_dir).join(instruments(spark, sf_dir), "symbol", "left")
    return j.groupBy("sector").agg(F.round(F.sum("value"), 2).alias("market_value"), F.round(F.sum("pnl"), 2).alias("pnl"))


_MINUTES = f"(SELECT symbol, ts_millis // 60000 AS minute, CAST(arg_max(mid, struct_pack(a := ts_millis, b := seq)) AS double) AS mid FROM {_TICKS} GROUP BY 1, 2)"


@query(f"""WITH m AS {_MINUTES}, b AS (SELECT symbol, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS q FROM ({OPERATIONS["basket_positions"]})),
  t AS (SELECT DISTINCT minute FROM m JOIN b USING (symbol)), s AS (SELECT DISTINCT symbol FROM b),
  v AS (SELECT t.minute, q * mid AS v FROM t CROSS JOIN s ASOF JOIN m ON m.symbol = s.symbol AND t.minute >= m.minute JOIN b ON b.symbol = s.symbol)
  SELECT minute, count(*) AS marked, round(sum(v), 4) AS value FROM v GROUP BY 1""")
def basket_value_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The basket's value at the end of every minute in which one of its symbols was quoted, each symbol at its latest mid so far: what a trigger would have recorded.

    Each quote adds what it changes; the changes of a minute are summed before they run on over time.
    """
    b = basket_positions(spark, sf_dir).select("symbol", F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity")).alias("q"))
    m = ticks(spark, sf_dir).withColumn("minute", F.expr("ts_millis div 60000")).groupBy("symbol", "minute").agg(F.max_by("mid", F.struct("ts_millis", "seq")).cast("double").alias("mid"))
    d = series.previous(m.join(b, "symbol"), ["symbol"], F.col("minute"), F.struct("minute", "mid"), 1440)
    change = F.col("q") * (F.col("mid") - F.coalesce("__p.mid", F.lit(0.0)))
    per = d.groupBy("minute").agg(F.sum(change).alias("change"), F.count_if(F.col("__p").isNull()).alias("new"))
    out = series.running(per, [], F.col("minute"), [], {"value": ("sum", F.col("change")), "marked": ("sum", F.col("new"))}, width=1440)
    return out.select("minute", "marked", F.round("value", 4).alias("value"))


# -- trace windows --

#: The share of traces that are kept, by which counts are scaled up, and the errors among the stages.
SAMPLE = 0.25
ERRORS = ("FAILED", "BLOCKED", "PARKED")
TERMINAL = ("DONE", "DROPPED", "FAILED", "REJECTED", "BLOCKED", "PARKED")
#: Stages of a machine as the traces name them.
FIRST_STATE, LAST_STATE = "S0", "S5"
_MEASURES = {"e2e": ("DONE", "e2eMs"), "source": ("DONE", "srcMs"), "ingest": ("RECEIVED", "kinesisMs"), "dedupe": ("RECEIVED", "dedupeMs"), "lock_wait": ("LOCK_WAIT", "waitedMs")}


def _number(name: str) -> Column:
    return F.nullif(F.regexp_extract("detail", rf"\b{name}=(-?[0-9]+)", 1), F.lit("")).try_cast("double")


_STAGES = ("RECEIVED", "LOCK_GRANTED", "TRANSITION", "DONE", "DROPPED", "REJECTED")
_WINDOW = ", ".join(f"CAST(round(count(*) FILTER (stage = '{s}') / {SAMPLE}) AS bigint) AS {s.lower()}" for s in _STAGES)


@query(f"""WITH t AS (SELECT {_FLOW} AS flow, * FROM {_TRACE}), w AS (SELECT greatest(1000, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000) AS covered FROM t)
  SELECT flow, {_WINDOW}, CAST(round(count(*) FILTER (stage IN {ERRORS}) / {SAMPLE}) AS bigint) AS errors, CAST(round(count(*) FILTER (stage = 'TRANSITION' AND detail LIKE '% -> {LAST_STATE}') / {SAMPLE}) AS bigint) AS completed,
    round(round(count(*) FILTER (stage = 'DONE') / {SAMPLE}) * 10000.0 / any_value(covered)) / 10.0 AS done_per_sec, max(ts) AS last_seen FROM t, w WHERE flow IS NOT NULL GROUP BY 1""")
def flow_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flow: events at each stage, errors and completed instances, scaled up from the sample, and events done per second of the covered time, to a tenth."""
    t = _traces(spark, sf_dir).withColumn("flow", flow_of(F.col("workflow_id"))).withColumn("ms", _millis("ts"))
    w = t.agg(F.greatest(F.lit(1000), F.max("ms") - F.min("ms")).alias("covered"))  # one row
    stage = F.col("stage")
    scaled = lambda c: F.round(F.count_if(c) / SAMPLE).cast("bigint")
    moved_last = (stage == "TRANSITION") & F.col("detail").endswith(f" -> {LAST_STATE}")
    g = t.where("flow is not null").groupBy("flow").agg(*[scaled(stage == s).alias(s.lower()) for s in _STAGES], scaled(stage.isin(*ERRORS)).alias("errors"), scaled(moved_last).alias("completed"), F.max("ts").alias("last_seen"))
    return g.crossJoin(F.broadcast(w)).withColumn("done_per_sec", F.round(F.col("done") * 10000.0 / F.col("covered")) / 10.0).drop("covered")


_LISTS = " UNION ALL ".join(f"SELECT {_FLOW} AS flow, '{m}' AS measure, try_cast(nullif(regexp_extract(detail, '\\b{n}=(-?[0-9]+)', 1), '') AS double) AS x FROM {_TRACE} WHERE stage = '{s}'" for m, (s, n) in _MEASURES.items())


@query(f"""SELECT flow, measure, count(*) AS n, list_sort(list(x))[least(count(*), floor(0.5 * count(*)) + 1)::int] AS p50, list_sort(list(x))[least(count(*), floor(0.95 * count(*)) + 1)::int] AS p95, list_sort(list(x))[least(count(*), floor(0.99 * count(*)) + 1)::int] AS p99, max(x) AS largest
  FROM ({_LISTS}) WHERE flow IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2""")
def flow_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles, per flow, of every latency that the traces' details give."""
    of = [F.when(F.col("stage") == s, F.struct(F.lit(m).alias("measure"), _number(n).alias("x"))) for m, (s, n) in _MEASURES.items()]
    d = _traces(spark, sf_dir).select(flow_of(F.col("workflow_id")).alias("flow"), F.inline(F.filter(F.array(*of), lambda s: s.isNotNull()))).where("flow is not null")
    return ranks.wide(ranks.at_ranks(d, ["flow", "measure"], F.col("x"), [0.5, 0.95, 0.99], "floor"), ["flow", "measure"], {0.5: "p50", 0.95: "p95", 0.99: "p99"}).drop("mean")


@query(f"""WITH t AS (SELECT workflow_id, ts, trace_id, detail FROM {_TRACE} WHERE workflow_id IS NOT NULL AND stage = 'TRANSITION' AND (detail LIKE '{FIRST_STATE} -> %' OR detail LIKE '% -> {LAST_STATE}')),
  s AS (SELECT *, sum(CASE WHEN detail LIKE '{FIRST_STATE} -> %' THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY ts, trace_id) AS seg FROM t),
  l AS (SELECT workflow_id, epoch_us(min(ts) FILTER (detail LIKE '% -> {LAST_STATE}')) - epoch_us(min(ts) FILTER (detail LIKE '{FIRST_STATE} -> %')) AS us FROM s WHERE seg > 0 GROUP BY workflow_id, seg)
  SELECT {_FLOW} AS flow, count(*) AS started, count(us) AS completed, round(avg(us) / 1000, 4) AS mean_ms, max(us) / 1000 AS max_ms FROM l WHERE {_FLOW} IS NOT NULL GROUP BY 1""")
def flow_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flow: instances that began, those that came to their last state, and how long that took."""
    t = _traces(spark, sf_dir).where("workflow_id is not null and stage = 'TRANSITION'")
    l = series.lifetimes(t, ["workflow_id"], micros("ts"), F.col("detail").startswith(f"{FIRST_STATE} -> "), F.col("detail").endswith(f" -> {LAST_STATE}"), [F.col("trace_id")])
    us = F.col("ended_us") - F.col("started_us")
    return l.groupBy(flow_of(F.col("workflow_id")).alias("flow")).agg(F.count(F.lit(1)).alias("started"), F.count(us).alias("completed"), F.round(F.avg(us) / 1000, 4).alias("mean_ms"), (F.max(us) / 1000).alias("max_ms")).where("flow is not null")


_NEWEST = "QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY ts DESC, trace_id DESC) <= {n}"


@query(f"SELECT flow, trace_id, event_id, ts, stage, detail FROM (SELECT {_FLOW} AS flow, * FROM {_TRACE}) WHERE flow IS NOT NULL AND stage IN {(*ERRORS, 'REJECTED')} " + _NEWEST.format(by="flow", n=25))
def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 25 errors of each flow."""
    t = _traces(spark, sf_dir).withColumn("flow", flow_of(F.col("workflow_id"))).where(F.col("flow").isNotNull() & F.col("stage").isin(*ERRORS, "REJECTED"))
    return latest_by(t, ["flow"], [F.col("ts"), F.col("trace_id")], per_key=25).select("flow", "trace_id", "event_id", "ts", "stage", "detail")


@query(f"SELECT trace_id, event_id, ts, stage FROM {_TRACE} WHERE ts >= TIMESTAMP '2025-03-03 09:30:00' ORDER BY ts DESC, trace_id DESC LIMIT 20000")
def traces_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window's newest traces, at most 20 000."""
    since = F.lit("2025-03-03 09:30:00").cast("timestamp_ntz")
    return _traces(spark, sf_dir).where(F.col("ts") >= since).select("trace_id", "event_id", "ts", "stage").orderBy(F.desc("ts"), F.desc("trace_id")).limit(20000)


@query(f"SELECT trace_id, event_id, ts, stage FROM {_TRACE} WHERE stage IN {TERMINAL} ORDER BY ts DESC, trace_id DESC LIMIT 50")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty events that came to an end."""
    t = _traces(spark, sf_dir).where(F.col("stage").isin(*TERMINAL))
    return t.select("trace_id", "event_id", "ts", "stage").orderBy(F.desc("ts"), F.desc("trace_id")).limit(50)


_SECTIONS = """SELECT unnest(['ingest', 'dedupe', 'lock', 'entity', 'apply', 'total']) AS section, unnest([kin, ded, CAST(epoch_us(g) - epoch_us(r) AS double) / 1000, CAST(epoch_us(m) - epoch_us(g) AS double) / 1000, CAST(epoch_us(d) - epoch_us(m) AS double) / 1000, CAST(epoch_us(d) - epoch_us(r) AS double) / 1000 + ded]) AS ms FROM (
  SELECT event_id, max(try_cast(nullif(regexp_extract(detail, 'kinesisMs=(-?[0-9]+)', 1), '') AS double)) FILTER (stage = 'RECEIVED') AS kin, max(try_cast(nullif(regexp_extract(detail, 'dedupeMs=(-?[0-9]+)', 1), '') AS double)) FILTER (stage = 'RECEIVED') AS ded,
    max(ts) FILTER (stage = 'RECEIVED') AS r, max(ts) FILTER (stage = 'LOCK_GRANTED') AS g, max(ts) FILTER (stage = 'TRANSITION') AS m, max(ts) FILTER (stage = 'DONE') AS d
  FROM (SELECT event_id, stage, min(ts) AS ts, min(detail) AS detail FROM event_trace GROUP BY 1, 2) GROUP BY 1) WHERE d IS NOT NULL"""


@query(f"SELECT section, count(ms) AS n, round(avg(ms), 4) AS mean_ms, quantile_cont(ms, 0.5) AS p50_ms, quantile_cont(ms, 0.99) AS p99_ms FROM ({_SECTIONS}) WHERE ms IS NOT NULL GROUP BY 1")
def pipeline_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six sections of an event's way from arrival to its end, for events that came to it."""
    first = table(spark, sf_dir, "event_trace").groupBy("event_id", "stage").agg(F.min("ts").alias("ts"), F.min("detail").alias("detail"))
    at = lambda s: F.max(F.when(F.col("stage") == s, micros("ts")))
    told = lambda n: F.max(F.when(F.col("stage") == "RECEIVED", _number(n)))
    p = first.groupBy("event_id").agg(told("kinesisMs").alias("kin"), told("dedupeMs").alias("ded"), at("RECEIVED").alias("r"), at("LOCK_GRANTED").alias("g"), at("TRANSITION").alias("m"), at("DONE").alias("d")).where("d is not null")
    ms = lambda a, b: (F.col(b) - F.col(a)).cast("double") / 1000
    parts = {"ingest": F.col("kin"), "dedupe": F.col("ded"), "lock": ms("r", "g"), "entity": ms("g", "m"), "apply": ms("m", "d"), "total": ms("r", "d") + F.col("ded")}
    s = p.select(F.inline(F.array(*[F.struct(F.lit(n).alias("section"), c.alias("ms")) for n, c in parts.items()])))
    r = ranks.wide(ranks.interpolated(s, ["section"], F.col("ms"), [0.5, 0.99]), ["section"], {0.5: "p50_ms", 0.99: "p99_ms"})
    return r.select("section", "n", F.round("mean", 4).alias("mean_ms"), "p50_ms", "p99_ms")


# -- rates and runs --

#: Milliseconds: the window of a rate, how long samples are kept, and how far apart two are at least to be kept and to give a rate.
RATE_WINDOW, RATE_KEPT, RATE_SLOT, RATE_APART = 60_000, 3_600_000, 500, 1000

_RATE = f"""WITH s AS (SELECT run_id, epoch_us(ts) // 1000 // {RATE_SLOT} AS slot, arg_min(struct_pack(ms := epoch_us(ts) // 1000, v := completed), struct_pack(ms := epoch_us(ts) // 1000, v := completed)) AS r FROM perf_samples WHERE ts IS NOT NULL AND completed IS NOT NULL GROUP BY 1, 2),
  p AS (SELECT run_id, r.ms AS ms, r.v AS v, lag(r) OVER (PARTITION BY run_id ORDER BY r.ms) AS q FROM s), g AS (SELECT *, sum(CASE WHEN v < q.v THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ms) AS seg FROM p),
  b AS (SELECT *, first(struct_pack(ms := ms, v := v)) OVER (PARTITION BY run_id, seg ORDER BY ms RANGE BETWEEN {RATE_WINDOW} PRECEDING AND CURRENT ROW) AS near, first(struct_pack(ms := ms, v := v)) OVER (PARTITION BY run_id, seg ORDER BY ms RANGE BETWEEN {RATE_KEPT} PRECEDING AND CURRENT ROW) AS kept,
    lag(struct_pack(ms := ms, v := v)) OVER (PARTITION BY run_id, seg ORDER BY ms) AS before FROM g),
  c AS (SELECT *, CASE WHEN ms - near.ms >= {RATE_APART} THEN near WHEN kept.ms < ms THEN kept ELSE before END AS base FROM b)
  SELECT run_id, ms, v AS completed, CASE WHEN ms - base.ms >= {RATE_APART} THEN round((v - base.v) * 10000.0 / (ms - base.ms)) / 10.0 END AS rate FROM c"""


@query(_RATE)
def completion_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every sample of a run its counter's rate per second, to a tenth: against the first sample in the last minute, else the oldest still kept, never across a reset, and never over less than a second.

    Of samples in one half second the first is kept.
    """
    s = table(spark, sf_dir, "perf_samples").select("run_id", _millis("ts").alias("ms"), F.col("completed").alias("v")).where("ms is not null and v is not null")
    s = s.groupBy("run_id", F.expr(f"ms div {RATE_SLOT}").alias("slot")).agg(F.min(F.struct("ms", "v")).alias("r")).select("run_id", "r.*")
    r = series.counter_base(s, ["run_id"], F.col("ms"), F.col("v"), RATE_WINDOW, RATE_KEPT, RATE_APART)
    base = F.col("base")
    rate = F.when(F.col("ms") - base["ms"] >= RATE_APART, F.round((F.col("v") - base["v"]) * 10000.0 / (F.col("ms") - base["ms"])) / 10.0)
    return r.select("run_id", "ms", F.col("v").alias("completed"), rate.alias("rate"))


_FINITE = "{c} >= 0 AND NOT isnan({c}) AND NOT isinf({c})"


@query(f"""WITH s AS (SELECT DISTINCT run_id, ts, t_sec, latency_p50 FROM perf_samples WHERE {_FINITE.format(c="latency_p50")} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, t_sec DESC, latency_p50 DESC) <= 2048)
  SELECT run_id, count(*) AS n, quantile_disc(latency_p50, 0.5) AS p50, quantile_disc(latency_p50, 0.99) AS p99 FROM s GROUP BY 1""")
def recent_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of each run's last 2048 measurements."""
    s = table(spark, sf_dir, "perf_samples").select("run_id", "ts", "t_sec", "latency_p50").where("latency_p50 >= 0 and not isnan(latency_p50) and latency_p50 < double('Infinity')").distinct()
    s = latest_by(s, ["run_id"], [F.col("ts"), F.col("t_sec"), F.col("latency_p50")], per_key=2048)
    return ranks.wide(ranks.at_ranks(s, ["run_id"], F.col("latency_p50"), [0.5, 0.99], "nearest"), ["run_id"], {0.5: "p50", 0.99: "p99"}).drop("mean", "largest")


def _ok(c: str) -> Column:
    v = F.col(c)
    return F.when((v >= 0) & ~F.isnan(v) & (v < float("inf")), v)


@query("""WITH s AS (SELECT DISTINCT * FROM perf_samples), n AS (SELECT * REPLACE ({ok}) FROM s)
  SELECT run_id, count(ts) AS samples, round(avg(completed_per_sec) FILTER (loading), 6) AS avg_completed_per_sec, max(completed_per_sec) AS peak_completed_per_sec, round(avg(processed_per_sec) FILTER (loading), 6) AS avg_processed_per_sec,
    round(avg(dispatched_per_sec) FILTER (loading), 6) AS avg_dispatched_per_sec, sum(completed) AS completed, sum(errored) AS errored, sum(rejected) AS rejected, median(latency_p50) FILTER (loading) AS latency_p50, round(avg(latency_p95) FILTER (loading), 6) AS latency_p95,
    max(latency_p99) AS latency_p99_max, median(lifetime_p50) FILTER (loading) AS lifetime_p50, max(t_sec) AS seconds, count(*) FILTER (NOT kafka_up) AS disruptions FROM n GROUP BY 1""".replace("{ok}", ", ".join(f"CASE WHEN {_FINITE.format(c=c)} THEN {c} END AS {c}" for c in ("completed_per_sec", "processed_per_sec", "dispatched_per_sec", "latency_p50", "latency_p95", "latency_p99", "lifetime_p50"))))
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of a run: rates while it was loaded, totals, its latencies, and samples without the log."""
    s = table(spark, sf_dir, "perf_samples").distinct()
    s = s.withColumns({c: _ok(c) for c in ("completed_per_sec", "processed_per_sec", "dispatched_per_sec", "latency_p50", "latency_p95", "latency_p99", "lifetime_p50")})
    loaded = lambda c: F.when(F.col("loading"), F.col(c))
    mean = lambda c: F.round(F.avg(loaded(c)), 6)
    a = s.groupBy("run_id").agg(
        F.count("ts").alias("samples"), mean("completed_per_sec").alias("avg_completed_per_sec"), F.max("completed_per_sec").alias("peak_completed_per_sec"), mean("processed_per_sec").alias("avg_processed_per_sec"), mean("dispatched_per_sec").alias("avg_dispatched_per_sec"),
        *[F.sum(c).alias(c) for c in ("completed", "errored", "rejected")], mean("latency_p95").alias("latency_p95"), F.max("latency_p99").alias("latency_p99_max"), F.max("t_sec").alias("seconds"), F.count_if(~F.col("kafka_up")).alias("disruptions"),
    )
    two = s.where("loading").select("run_id", F.inline(F.array(*[F.struct(F.lit(c).alias("m"), F.col(c).alias("x")) for c in ("latency_p50", "lifetime_p50")])))
    med = ranks.interpolated(two, ["run_id", "m"], F.col("x"), [0.5]).groupBy("run_id").agg(*[F.max(F.when(F.col("m") == c, F.col("value"))).alias(c) for c in ("latency_p50", "lifetime_p50")])
    return a.join(med, "run_id", "left")


# -- completeness --

_ID = "lower(trim({c}))"
_EXPECTED = f"""WITH m AS (SELECT sm_type || ':' || instance_key AS wf, any_value(sm_type) AS sm_type, count(DISTINCT {_ID.format(c='event_id')}) AS expected FROM event_envelope WHERE style = 'entity' AND instance_key IS NOT NULL GROUP BY 1),
  t AS (SELECT workflow_id AS wf, {_ID.format(c='event_id')} AS id, min(epoch_us(ts)) FILTER (stage = 'RECEIVED') AS got, min(epoch_us(ts)) FILTER (stage = 'DONE') AS done FROM event_trace WHERE workflow_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1, 2),
  o AS (SELECT wf, id, done, max(done) OVER (PARTITION BY wf ORDER BY got, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM t WHERE done IS NOT NULL AND got IS NOT NULL),
  a AS (SELECT wf, count(DISTINCT id) AS applied FROM t WHERE done IS NOT NULL GROUP BY 1), x AS (SELECT wf, count(*) FILTER (done < top) AS ooo FROM o GROUP BY 1)
  SELECT sm_type, count(*) AS keys, count(*) FILTER (coalesce(applied, 0) < expected) AS lost_keys, coalesce(sum(expected - coalesce(applied, 0)) FILTER (coalesce(applied, 0) < expected), 0) AS lost,
    count(*) FILTER (applied > expected) AS over_keys, coalesce(sum(applied - expected) FILTER (applied > expected), 0) AS over, coalesce(sum(ooo), 0) AS out_of_order FROM m LEFT JOIN a ON m.wf = a.wf LEFT JOIN x ON m.wf = x.wf GROUP BY 1"""


@query(_EXPECTED)
def expected_and_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: how many events its instances were sent and how many were applied, by instances that lack some or have too many, and events applied before one that came earlier."""
    env = table(spark, sf_dir, "event_envelope").where("style = 'entity' and instance_key is not null")
    m = env.groupBy(F.concat_ws(":", "sm_type", "instance_key").alias("wf")).agg(F.first("sm_type").alias("sm_type"), F.count_distinct(F.lower(F.trim("event_id"))).alias("expected"))
    at = lambda s: F.min(F.when(F.col("stage") == s, micros("ts")))
    t = table(spark, sf_dir, "event_trace").where("workflow_id is not null and event_id is not null").groupBy(F.col("workflow_id").alias("wf"), F.lower(F.trim("event_id")).alias("id")).agg(at("RECEIVED").alias("got"), at("DONE").alias("done")).where("done is not null")
    applied = t.groupBy("wf").agg(F.count(F.lit(1)).alias("applied"))
    o = series.running(t.where("got is not null"), ["wf"], F.col("got"), [F.col("id")], {"top": ("max", F.col("done"))}, own=False)
    ooo = o.groupBy("wf").agg(F.count_if(F.col("done") < F.col("top")).alias("ooo"))
    j = m.join(applied, "wf", "left").join(ooo, "wf", "left").withColumn("a", F.coalesce("applied", F.lit(0)))
    less, more = F.col("a") < F.col("expected"), F.col("a") > F.col("expected")
    total = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return j.groupBy("sm_type").agg(F.count(F.lit(1)).alias("keys"), F.count_if(less).alias("lost_keys"), total(less, F.col("expected") - F.col("a")).alias("lost"), F.count_if(more).alias("over_keys"), total(more, F.col("a") - F.col("expected")).alias("over"), F.coalesce(F.sum("ooo"), F.lit(0)).alias("out_of_order"))


_PAY = """WITH p AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'SETTLED' WHEN 'P' THEN 'DECLINED' ELSE 'FAILED' END AS outcome FROM orders),
  c AS (SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS commits, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS refunded FROM lineitem WHERE l_linenumber <= 2 AND l_linestatus = 'F' GROUP BY 1)
  SELECT outcome, count(*) AS payments, count(*) FILTER (coalesce(commits, 0) > 1) AS committed_twice, count(*) FILTER (CASE outcome WHEN 'SETTLED' THEN coalesce(commits, 0) - coalesce(refunded, 0) <> 1 OR refunded > 0 WHEN 'DECLINED' THEN commits > 0 ELSE commits > refunded END) AS violations FROM p LEFT JOIN c USING (id) GROUP BY 1"""


@query(_PAY)
def outcomes_and_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with an outcome held against the effects they had outside: settled ones have one live effect and none taken back, declined ones none, failed ones none that is still live; repeated records of one effect count once."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "SETTLED").when(F.col("o_orderstatus") == "P", "DECLINED").otherwise("FAILED").alias("outcome"))
    l = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2 and l_linestatus = 'F'")
    effects = l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("effect"), (F.col("l_returnflag") == "R").alias("undone"))
    return effect_check(o, effects)


def effect_check(outcomes: DataFrame, effects: DataFrame) -> DataFrame:
    """(outcome, payments, committed_twice, violations) from (id, outcome) and (id, effect, undone); records of one effect may repeat."""
    c = effects.groupBy("id").agg(F.count_distinct("effect").alias("commits"), F.count_distinct(F.when(F.col("undone"), F.col("effect"))).alias("refunded"))
    j = outcomes.join(c, "id", "left").na.fill(0, ["commits", "refunded"])
    live = F.col("commits") - F.col("refunded")
    wrong = F.when(F.col("outcome") == "SETTLED", (live != 1) | (F.col("refunded") > 0)).when(F.col("outcome") == "DECLINED", F.col("commits") > 0).otherwise(live > 0)
    return j.groupBy("outcome").agg(F.count(F.lit(1)).alias("payments"), F.count_if(F.col("commits") > 1).alias("committed_twice"), F.count_if(wrong).alias("violations"))


@query("SELECT status, count(*) AS n FROM processed_event WHERE event_id LIKE 'b%' GROUP BY 1")
def dedupe_status_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "processed_event").where(F.col("event_id").like("b%")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_GROUPS = {"sink": "2025-06-01 00:00:00", "audit": "2024-06-01 00:00:00"}
_LAG = " UNION ALL ".join(f"SELECT '{g}' AS reader, topic_partition, max(topic_offset) + 1 AS end_offset, coalesce(max(topic_offset) FILTER (published_at <= TIMESTAMP '{t}') + 1, 0) AS committed FROM entity_snapshot GROUP BY topic_partition" for g, t in _GROUPS.items())


@query(f"SELECT reader, sum(end_offset) AS end_offset, sum(committed) AS committed, sum(greatest(0, end_offset - committed)) AS lag FROM ({_LAG}) GROUP BY 1")
def readers_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each of several readers is behind, over all partitions; a reader stands where it had read up to its time."""
    f = table(spark, sf_dir, "entity_snapshot")
    at = [F.coalesce(F.max(F.when(F.col("published_at") <= F.lit(t).cast("timestamp_ntz"), F.col("topic_offset"))) + 1, F.lit(0)).alias(g) for g, t in _GROUPS.items()]
    p = f.groupBy("topic_partition").agg((F.max("topic_offset") + 1).alias("end_offset"), *at)
    each = p.select("end_offset", F.inline(F.array(*[F.struct(F.lit(g).alias("reader"), F.col(g).alias("committed")) for g in _GROUPS])))
    return each.groupBy("reader").agg(F.sum("end_offset").alias("end_offset"), F.sum("committed").alias("committed"), F.sum(F.greatest(F.lit(0), F.col("end_offset") - F.col("committed"))).alias("lag"))


@query("SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def tail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hundred events."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


#: Ticks that a ring holds.
RING = 5000


@query(f"SELECT symbol, count(*) AS ticks, round(avg(CAST(ask - bid AS double)), 6) AS mean_spread, min(ts_millis) AS since FROM (SELECT * FROM {_TICKS} ORDER BY ts_millis DESC, symbol, seq DESC LIMIT {RING}) GROUP BY 1")
def ring_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures over the newest ticks only, as a ring of that size would hold them."""
    ring = ticks(spark, sf_dir).select("symbol", "seq", "ts_millis", "bid", "ask").orderBy(F.desc("ts_millis"), "symbol", F.desc("seq")).limit(RING)
    return ring.groupBy("symbol").agg(F.count(F.lit(1)).alias("ticks"), F.round(F.avg((F.col("ask") - F.col("bid")).cast("double")), 6).alias("mean_spread"), F.min("ts_millis").alias("since"))


@query("""SELECT sm_type, count(*) AS deliveries, count(*) FILTER (keys = 1) AS single_key, count(*) FILTER (direct AND keys = 1) AS direct FROM (
  SELECT sm_type, direct, len(list_distinct(CASE WHEN style = 'event' THEN CASE WHEN len(lock_keys) = 0 THEN [sm_type || ':' || event_id] ELSE lock_keys END ELSE list_append(lock_keys, sm_type || ':' || instance_key) END)) AS keys FROM event_envelope) GROUP BY 1""")
def direct_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: deliveries that hold a single key, and those of them that may go past the locks."""
    own = F.concat_ws(":", "sm_type", "instance_key")
    alone = F.array(F.concat_ws(":", "sm_type", "event_id"))
    k = F.size(F.array_distinct(F.when(F.col("style") == "event", F.when(F.size("lock_keys") == 0, alone).otherwise(F.col("lock_keys"))).otherwise(F.array_append("lock_keys", own))))
    one = k == 1
    return table(spark, sf_dir, "event_envelope").groupBy("sm_type").agg(F.count(F.lit(1)).alias("deliveries"), F.count_if(one).alias("single_key"), F.count_if(F.col("direct") & one).alias("direct"))

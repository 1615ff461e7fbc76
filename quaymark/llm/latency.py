"""Percentiles of latencies and of the time between stages (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.functions.columns import micros
from quaymark.llm.quantiles import EPSILON, combine, percentiles, summarize
from quaymark.session import materialize
from quaymark.sources.tables import table

PS = (0.5, 0.9, 0.95, 0.99)


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, day, latency_p95); repeated rows count once, what is no measurement doesn't."""
    d = table(spark, sf_dir, "perf_samples").select("run_id", "ts", "t_sec", "latency_p95").where("latency_p95 >= 0").distinct()
    return d.select("run_id", F.to_date("ts").alias("day"), "latency_p95")


def latency_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(latencies(spark, sf_dir), ["run_id", "day"], "latency_p95")


def stage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, from_stage, to_stage, gap_ms) between neighbouring visits of an event, in order of time; day is that of the earlier.

    A stage visited again counts again. Rows of an event that repeat a trace_id count once, at their
    earliest time; without trace_id, those that repeat stage and time. Of visits at one time, the
    stages' names decide. Rows without event, stage or time are no visits.
    """
    t = table(spark, sf_dir, "event_trace").select("event_id", "trace_id", "stage", micros("ts").alias("us")).where("event_id is not null and stage is not null and us is not null")
    # Spread by event once, for the repeated rows and for the order; the window streams over its sorted rows.
    t = t.repartition("event_id").withColumn("same", F.when(F.col("trace_id").isNull(), F.struct("us", "stage")))
    visits = t.groupBy("event_id", "trace_id", "same").agg(F.min(F.struct("us", "stage")).alias("v")).select("event_id", "v.us", "v.stage")
    w = Window.partitionBy("event_id").orderBy("us", "stage")
    steps = visits.select("us", F.col("stage").alias("from_stage"), F.lead("stage").over(w).alias("to_stage"), F.lead("us").over(w).alias("then")).where("to_stage is not null")
    return steps.select(F.to_date(F.timestamp_micros("us")).alias("day"), "from_stage", "to_stage", ((F.col("then") - F.col("us")) / 1000.0).alias("gap_ms"))


def gap_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["from_stage", "to_stage", "day"]
    return summarize(stage_gaps(spark, sf_dir), by, "gap_ms")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of both measures, from summaries per day: (measure, run_id, from_stage, to_stage, n, p, value, rank_error)."""
    lat = percentiles(combine(latency_summaries(spark, sf_dir), ["run_id"]), ["run_id"], PS)
    gap = percentiles(combine(gap_summaries(spark, sf_dir), ["from_stage", "to_stage"]), ["from_stage", "to_stage"], PS)
    none = F.lit(None).cast("string")
    a = lat.select(F.lit("latency_p95").alias("measure"), "run_id", none.alias("from_stage"), none.alias("to_stage"), "n", "p", "value", "rank_error")
    b = gap.select(F.lit("stage_gap_ms").alias("measure"), none.alias("run_id"), "from_stage", "to_stage", "n", "p", "value", "rank_error")
    return a.unionAll(b)


def p5_latency_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["run_id", "day"]
    return percentiles(combine(latency_summaries(spark, sf_dir), by), by, PS)


def p5_gaps_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["from_stage", "to_stage", "day"]
    return percentiles(combine(gap_summaries(spark, sf_dir), by), by, PS)


def within_stated_error(values: DataFrame, answers: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., n, p, within): whether each answer's rank among all values is off by at most its stated error. For checks: it reads all values again.

    Groups compare null-safe; only values that `summarize` takes are counted. Answers come as one
    row per group, so the values are joined to as many rows as there are groups.
    """
    asked = answers.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("p", "value", "rank_error"))).alias("asked"))
    v = values.select(*[F.col(b).alias(f"__{b}") for b in by], F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('Infinity')")
    same = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    ps = sorted(PS)
    at = lambda i: F.col("asked")[i]["value"]
    n = asked.join(v, same).groupBy(*by, "asked").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.struct(F.count_if(F.col("__v") < at(i)).alias("less"), F.count_if(F.col("__v") <= at(i)).alias("upto")) for i in range(len(ps))]).alias("ranks"))
    d = n.select(*by, "n", F.inline(F.arrays_zip("asked", "ranks"))).select(*by, "n", "asked.*", "ranks.*")
    rank = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n")))
    off = F.greatest(F.lit(0), F.col("less") + 1 - rank, rank - F.col("upto"))
    return d.select(*by, "n", "p", (off <= F.col("rank_error") * F.col("n") + 1e-6).alias("within"), (F.col("rank_error") <= EPSILON).alias("as_permitted"))


def p5_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_percentiles held against the exact ranks: (measure, run_id, from_stage, to_stage, n, p, within, as_permitted)."""
    told = materialize(p5_percentiles(spark, sf_dir), "answers")
    stages = ["from_stage", "to_stage"]
    lat = within_stated_error(latencies(spark, sf_dir), told.where("measure = 'latency_p95'"), ["run_id"], "latency_p95")
    gap = within_stated_error(stage_gaps(spark, sf_dir), told.where("measure = 'stage_gap_ms'"), stages, "gap_ms")
    none = F.lit(None).cast("string")
    a = lat.select(F.lit("latency_p95").alias("measure"), "run_id", none.alias("from_stage"), none.alias("to_stage"), "n", "p", "within", "as_permitted")
    return a.unionAll(gap.select(F.lit("stage_gap_ms"), none, *stages, "n", "p", "within", "as_permitted"))


def queries() -> dict:
    return {f.__name__: f for f in (p5_percentiles, p5_latency_by_day, p5_gaps_by_day, p5_within)}


_VALUES = """
WITH lat AS (SELECT DISTINCT run_id, ts, t_sec, latency_p95 FROM perf_samples WHERE latency_p95 >= 0 AND NOT isnan(latency_p95) AND NOT isinf(latency_p95)),
visit AS (SELECT event_id, min((epoch_us(ts), stage)) AS v FROM event_trace WHERE event_id IS NOT NULL AND stage IS NOT NULL AND ts IS NOT NULL GROUP BY event_id, trace_id, CASE WHEN trace_id IS NULL THEN (epoch_us(ts), stage) END),
step AS (SELECT v, lead(v) OVER (PARTITION BY event_id ORDER BY v) AS x FROM visit),
counts AS (SELECT 'latency_p95' AS measure, run_id, NULL AS from_stage, NULL AS to_stage, count(*) AS n FROM lat GROUP BY run_id
  UNION ALL SELECT 'stage_gap_ms', NULL, v[2], x[2], count(*) FROM step WHERE x IS NOT NULL GROUP BY v[2], x[2])
"""
P5_WITHIN_SQL = _VALUES + f"SELECT measure, run_id, from_stage, to_stage, n, CAST(p AS double) AS p, true AS within, true AS as_permitted FROM counts, (SELECT unnest([{', '.join(map(str, PS))}]) AS p)"


def oracle_sql() -> dict[str, str]:
    return {"p5_within": P5_WITHIN_SQL}

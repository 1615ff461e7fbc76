"""Performance runs: what was asked for, the samples taken and the marks set on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.store.buckets import BucketTable

RUN = "run_id string, flow string, machine string, preset string, rate double, duration_sec int, chaos boolean, started_at timestamp, ended_at timestamp, status string"
SAMPLE = "run_id string, ts timestamp, t_sec int, loading boolean, completed_per_sec double, processed_per_sec double, completed bigint, errored bigint, rejected bigint, latency_p50 double, latency_p95 double, latency_p99 double"
MARK = "run_id string, ts timestamp, action string, target string, detail string"
#: Actions that count as disruptions, besides those that start with `CHAOS `.
DISRUPTIONS = ("KILL", "STOP")


class RunStore:
    """Opening it takes runs that were left running as interrupted."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8) -> None:
        self.runs, self.samples, self.marks = (BucketTable(spark, f"{folder}/{n}", s, "run_id", buckets) for n, s in (("runs", RUN), ("samples", SAMPLE), ("marks", MARK)))
        left = self.runs.read().where("status = 'running'")
        if not left.isEmpty():
            self.runs.apply(left, lambda now, _: now.withColumn("status", F.when(F.col("status") == "running", "interrupted").otherwise(F.col("status"))))

    def start(self, runs: DataFrame) -> None:
        """Rows without ended_at and status; a run that is there already stays as it is."""
        new = runs.withColumns({"ended_at": F.lit(None).cast("timestamp"), "status": F.lit("running")})
        self.runs.apply(new, lambda now, add: now.unionByName(add.join(now, "run_id", "left_anti").select(*self.runs.schema.names)))

    def add_samples(self, rows: DataFrame) -> None:
        self.samples.append(rows)

    def add_marks(self, rows: DataFrame) -> None:
        self.marks.append(rows)

    def end(self, ended: DataFrame) -> None:
        """ended: run_id, ended_at, status. A run that has ended already keeps its end."""

        def change(now: DataFrame, add: DataFrame) -> DataFrame:
            e = add.select("run_id", F.col("ended_at").alias("__at"), F.col("status").alias("__st"))
            j = now.join(e, "run_id", "left")
            open_ = F.col("ended_at").isNull() & F.col("__at").isNotNull()
            return j.withColumn("status", F.when(open_, F.col("__st")).otherwise(F.col("status"))).withColumn("ended_at", F.when(open_, F.col("__at")).otherwise(F.col("ended_at"))).drop("__at", "__st")

        self.runs.apply(ended, change)

    def summaries(self) -> DataFrame:
        """Every run with figures over its loading samples, its totals, and how often it was disrupted."""
        loaded = lambda c: F.when(F.col("loading"), F.col(c))
        s = self.samples.read().groupBy("run_id").agg(
            F.count("ts").alias("samples"), F.avg(loaded("completed_per_sec")).alias("avg_completed_per_sec"), F.max("completed_per_sec").alias("peak_completed_per_sec"), F.avg(loaded("processed_per_sec")).alias("avg_processed_per_sec"),
            *[F.sum(c).alias(c) for c in ("completed", "errored", "rejected")], F.avg(loaded("latency_p95")).alias("latency_p95"), F.max("latency_p99").alias("latency_p99_max"),
        )
        m = self.marks.read().where(F.col("action").like("CHAOS %") | F.col("action").isin(*DISRUPTIONS)).groupBy("run_id").agg(F.count(F.lit(1)).alias("disruptions"))
        return self.runs.read().join(s, "run_id", "left").join(m, "run_id", "left").na.fill(0, ["samples", "disruptions"])

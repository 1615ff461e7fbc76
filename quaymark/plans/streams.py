"""Stateful operators as queries: a machine run over a log, and the same counts from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.columns import micros
from quaymark.operators.machine_fold import Transitions, entities, replay
from quaymark.session import scratch
from quaymark.sources.tables import table
from quaymark.streaming.pipeline import deduplicated

#: How long after its first copy another may come.
DELAY = "45 days"

#: A visitor's last deliberate step; signing up twice and errors are refused.
VISIT = Transitions.parse("new", "; ".join(f"{s} -{e}-> {e}" for s in ("new", "view", "click", "purchase", "signup") for e in ("view", "click", "purchase", "signup") if (s, e) != ("signup", "signup")))

_ACCEPTED = """(SELECT *, CASE WHEN event_type = 'error' OR (event_type = 'signup' AND run > 1) THEN 0 ELSE 1 END AS ok FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS run FROM (SELECT *, sum(CASE WHEN event_type NOT IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp0,
    CASE WHEN event_type = 'signup' THEN sum(CASE WHEN event_type NOT IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) ELSE -event_id - 1 END AS grp FROM events)))"""

SQL = {
    "machine_entities": f"SELECT CAST(user_id AS varchar) AS key, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS state, count(*) AS version, CAST(arg_max(event_id, struct_pack(a := ts, b := event_id)) AS varchar) AS last_event_id FROM {_ACCEPTED} WHERE ok = 1 GROUP BY 1",
    "machine_outcomes": f"SELECT event_type AS event, ok = 1 AS accepted, count(*) AS n FROM {_ACCEPTED} GROUP BY 1, 2",
    "streamed_distinct_events": "SELECT sm_type, count(DISTINCT lower(trim(event_id))) AS events FROM event_envelope GROUP BY 1",
}


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.floor(micros("ts") / F.lit(86_400_000_000))
    return replay(e, F.col("user_id"), F.col("event_type"), [F.col("ts"), F.col("event_id")], day, VISIT, F.col("event_id"))


def machine_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every visitor's state after all events, with the number of accepted ones."""
    return entities(_told(spark, sf_dir))


def machine_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir).groupBy("event", (F.col("outcome") != "REJECTED").alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


def streamed_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per type, each id once, counted by a stream over the table's files; run until they are read.

    Copies are told by id as long as they come within DELAY of ingest time; ids older than that
    leave the state. Deliveries of unknown time (0) count as of the time at which they are read.
    """
    src = table(spark, sf_dir, "event_envelope")
    base = scratch(spark, "stream")
    s = spark.readStream.schema(src.schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event_envelope.parque[t]")
    ms = F.when(F.col("ingest_ts_millis") > 0, F.timestamp_millis("ingest_ts_millis")).otherwise(F.current_timestamp())
    one = deduplicated(s.select("sm_type", F.lower(F.trim("event_id")).alias("id"), ms.alias("at")).where("id is not null"), "id", F.col("at"), DELAY)
    q = one.select("sm_type", "id").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("sm_type string, id string").parquet(f"{base}/out").groupBy("sm_type").agg(F.count("id").alias("events"))


def queries() -> dict:
    return {f.__name__: f for f in (machine_entities, machine_outcomes, streamed_distinct_events)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

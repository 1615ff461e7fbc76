"""The batch operators on streams: deduplicated events, windows, guarded upserts, live tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.machine_fold import Transitions, streaming_fold
from quaymark.store.buckets import BucketTable, VersionedTable

ENVELOPE = "event_id string, sm_type string, instance_key string, event_type string, payload string, ingest_ts_millis bigint, seq bigint"


def envelopes(spark: SparkSession, folder: str, schema: str = ENVELOPE, files_per_trigger: int | None = None) -> DataFrame:
    """Newline-delimited JSON files as they arrive; lines that aren't JSON come with a null event_id and their text in _corrupt_record."""
    r = spark.readStream.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(folder)


def split_bad(d: DataFrame, needed: tuple[str, ...] = ("event_id", "sm_type", "event_type")) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows lack a needed field; they go to a dead-letter sink."""
    ok = F.lit(True)
    for c in needed:
        ok = ok & F.col(c).isNotNull()
    return d.where(ok), d.where(~ok)


def deduplicated(d: DataFrame, event_id: str, ts: Column, delay: str = "24 hours") -> DataFrame:
    """One copy of each id, as long as copies arrive within the delay. Identifiers are kept that long and no longer."""
    return d.withColumn("event_time", ts).withWatermark("event_time", delay).dropDuplicatesWithinWatermark([event_id])


def per_window(d: DataFrame, ts: str, width: str, by: list[str], delay: str) -> DataFrame:
    """Counts per tumbling window and key; rows later than the delay aren't counted."""
    return d.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def bars(d: DataFrame, symbol: str, ts: str, order: Column, price: str, size: str, width: str, delay: str) -> DataFrame:
    """Open, high, low, close, volume, vwap and count per window and key. Ticks later than the delay join no bar (in batch, every tick joins its bar)."""
    o, p, n = F.struct(F.col(ts), order), F.col(price), F.col(size)
    g = d.withWatermark(ts, delay).groupBy(F.window(ts, width).alias("w"), symbol)
    b = g.agg(F.min_by(p, o).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, o).alias("close"), F.sum(n).alias("volume"), (F.sum(p * n) / F.nullif(F.sum(n), F.lit(0))).alias("vwap"), F.count(F.lit(1)).alias("n"))
    return b.select(F.col("w.start").alias("bar_start"), symbol, "open", "high", "low", "close", "volume", "vwap", "n")


def time_table(spark: SparkSession, start_ms: int, end_ms: int, every_ms: int) -> DataFrame:
    """A row (ts) at each multiple of every_ms from start_ms up to end_ms."""
    n = F.col("id") * every_ms
    return spark.range(-(-start_ms // every_ms), -(-end_ms // every_ms)).select(F.timestamp_millis(n).alias("ts"))


def repeated(spark: SparkSession, every: str, action: Callable[[int], object], checkpoint: str):  # noqa: ANN201
    """Runs action(batch number) every so often, as a streaming query that can be stopped and, after a restart, goes on counting. A run that takes longer delays the next."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rate.writeStream.foreachBatch(lambda _, i: action(i)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def folded(d: DataFrame, spec: Transitions, key: str, event: str, order: str, idle_ms: int | None = None) -> DataFrame:
    """The state of each key after every micro-batch (update mode). A key without events for idle_ms is forgotten, with a last row (expired); its next event begins anew. Then the query runs batches without data as well, so it needs a trigger other than availableNow."""
    fold, out, held = streaming_fold(spec, event, order, idle_ms)
    return d.groupBy(key).applyInPandasWithState(fold, out, held, "update", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")


def live_history(quotes: DataFrame, folder: str, positions: DataFrame, symbol: str, mark: str, at: str, version: str):  # noqa: ANN201
    """A foreachBatch function and its two tables: every batch of quotes re-marks the positions, and the total is appended to a history with the batch's time.

    quotes: symbol, mark, at (time) and version; positions: symbol and quantity. Positions without a
    quote so far aren't in the total. A batch that is run again leaves the history as it is.
    """
    spark = positions.sparkSession
    kinds = dict(quotes.dtypes)
    latest = VersionedTable(spark, f"{folder}/quotes", ", ".join(f"`{c}` {kinds[c]}" for c in (symbol, mark, at, version)), symbol, version, at)
    history = BucketTable(spark, f"{folder}/history", f"batch bigint, as_of {kinds[at]}, marked bigint, value double", "batch", 8)

    def step(batch: DataFrame, batch_id: int) -> None:
        latest.upsert(batch.select(symbol, mark, at, version), batch_id)
        now = positions.join(latest.read(), symbol).agg(F.lit(batch_id).cast("bigint").alias("batch"), F.max(at).alias("as_of"), F.count(F.lit(1)).alias("marked"), F.sum(F.col("quantity") * F.col(mark)).cast("double").alias("value"))
        history.append(now, batch_id)

    return step, latest, history


def dead_letter(error: Column, target: str, attempts: Column | int, original: Column) -> Column:
    """What is known of a record that couldn't be stored: error on one line of at most 2000 signs, target, attempts, the record itself."""
    line = F.substring(F.regexp_replace(error, r"\s+", " "), 1, 2000)
    return F.struct(line.alias("error"), F.lit(target).alias("target"), (attempts if isinstance(attempts, Column) else F.lit(attempts)).cast("int").alias("attempts"), original.cast("string").alias("original"))


def deliver(batch: DataFrame, key: str, write: Callable[[DataFrame], None], set_aside: Callable[[DataFrame], None], target: str, max_attempts: int = 3, buckets: int = 16) -> None:
    """Write a batch; if it is refused max_attempts times, parts of it, until the rows that can't be written are found and set aside; only then the rest counts as written.

    Parts are cut by the hash of the key, `buckets` ways in each round, so a single bad key among n
    is found in about log(n) rounds. Rows of one key go together. Parts are written one after the
    other: `write` must not mind rows it has had before.
    """
    open_, depth = [F.lit(True)], 0
    while open_:
        refused: list[tuple[Column, str]] = []
        for part in open_:
            rows, error = batch.where(part), None
            for _ in range(max_attempts):
                try:
                    write(rows)
                    error = None
                    break
                except Exception as x:  # noqa: BLE001 (whatever a sink raises is its refusal)
                    error = f"{type(x).__name__}: {x}"
            if error is not None:
                refused.append((part, error))
        open_, depth = [], depth + 1
        for part, error in refused:
            if batch.where(part).select(key).distinct().limit(2).count() < 2 or depth > 12:
                rows = batch.where(part)
                set_aside(rows.select(dead_letter(F.lit(error), target, max_attempts, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))).alias("d")).select("d.*"))
            else:
                place = F.pmod(F.xxhash64(F.lit(depth), F.col(key)), F.lit(buckets))
                open_ += [part & (place == i) for i in range(buckets)]


#: Topics that carry entity snapshots.
SNAPSHOT_TOPICS = r"entity-snapshots|snapshots\..+"


def snapshot_topics(names: list[str], default: str = "entity-snapshots") -> list[str]:
    """Of the topics there are, those with snapshots, in order; the default if there is none."""
    return sorted(n for n in names if re.fullmatch(SNAPSHOT_TOPICS, n)) or [default]


def kafka_options(servers: str, pattern: str = SNAPSHOT_TOPICS, initial: str = "earliest") -> dict[str, str]:
    """Options of Spark's Kafka source for the snapshot topics: new topics are found by the pattern, a position that is no longer there falls back to the oldest one kept."""
    if initial not in ("earliest", "latest"):
        raise ValueError("initial is earliest or latest")
    return {"kafka.bootstrap.servers": servers, "subscribePattern": pattern, "startingOffsets": initial, "failOnDataLoss": "false", "kafka.isolation.level": "read_committed"}

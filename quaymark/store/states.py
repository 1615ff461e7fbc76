"""The store behind a running system: messages seen, entity states, checkpoints and traces, with batches in place of single calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.hashes import sampled
from quaymark.operators.latest import versioned_upsert
from quaymark.session import materialize
from quaymark.store.buckets import BucketTable

RECEIVED, DISPATCHED = "RECEIVED", "DISPATCHED"
TERMINAL = ("DONE", "DROPPED", "FAILED", "REJECTED", "BLOCKED", "PARKED")
STATE = "workflow_id string, sm_type string, state string, data string, version bigint, last_event_id string, updated_at timestamp"
TRACE = "event_id string, ts timestamp, stage string, workflow_id string, lock_key string, detail string"


def at_path(json: Column | str, path: str) -> Column:
    """The scalar at a dotted path of a JSON text, as text; null where there is none."""
    return F.get_json_object(json, "$" + "".join(f"['{p}']" for p in path.split(".")))


class StateStore:
    """All tables of a store under one folder. Every write is exactly once per batch; frames that come back are read from what was written."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        folder = folder.rstrip("/")
        self.spark = spark
        self.messages = BucketTable(spark, f"{folder}/messages", "event_id string, received_ms bigint, status string", "event_id", buckets)
        self.states = BucketTable(spark, f"{folder}/states", STATE, "workflow_id", buckets)
        self.checkpoints = BucketTable(spark, f"{folder}/checkpoints", "shard string, stream string, position string", "shard", min(buckets, 4))
        self.traces = BucketTable(spark, f"{folder}/traces", TRACE, "event_id", buckets)

    # -- messages --

    def claim(self, ids: DataFrame, now_ms: int) -> DataFrame:
        """(event_id) of those to dispatch: never seen, or seen and not dispatched (as after a crash). Each comes once, and counts as RECEIVED from its first time on. Null ids are left out."""
        ids = ids.select("event_id").where("event_id is not null").distinct()
        held = self.messages.read()
        claimed = materialize(ids.join(held.where(F.col("status") == DISPATCHED), "event_id", "left_anti"), "claimed")
        fresh = claimed.join(held, "event_id", "left_anti").select("event_id", F.lit(now_ms).cast("bigint").alias("received_ms"), F.lit(RECEIVED).alias("status"))
        if not fresh.isEmpty():
            self.messages.apply(fresh, lambda now, new: now.unionByName(new.join(now, "event_id", "left_anti")))
        return claimed

    def mark_dispatched(self, ids: DataFrame) -> None:
        def change(now: DataFrame, new: DataFrame) -> DataFrame:
            done = new.select("event_id", F.lit(True).alias("__done"))
            return now.join(done, "event_id", "left").withColumn("status", F.when(F.col("__done"), DISPATCHED).otherwise(F.col("status"))).drop("__done")

        self.messages.apply(ids.select("event_id").distinct(), change)

    def message_counts(self, prefix: str = "") -> DataFrame:
        return self.messages.read().where(F.col("event_id").startswith(prefix)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))

    def sweep(self, before_ms: int) -> int:
        """Messages first seen before that are forgotten; returns how many."""
        old = self.messages.read().where(F.col("received_ms") < before_ms)
        n = old.count()
        if n:
            self.messages.apply(old, lambda now, _: now.where(F.col("received_ms") >= before_ms))
        return n

    # -- checkpoints --

    def save_checkpoints(self, rows: DataFrame) -> None:
        """rows: stream, shard, position; the last of repeated ones is up to the caller."""
        self.checkpoints.apply(rows.select("shard", "stream", "position"), lambda now, new: now.join(new.select("shard", "stream"), ["shard", "stream"], "left_anti").unionByName(new))

    def checkpoint(self, stream: str, shard: str) -> str | None:
        r = self.checkpoints.read().where((F.col("stream") == stream) & (F.col("shard") == shard)).first()
        return r.position if r else None

    # -- states --

    def upsert(self, rows: DataFrame, traces: DataFrame | None = None) -> None:
        """Rows whose version exceeds the stored one, of several of a workflow the highest (ties: the latest); their traces with them."""
        self.states.apply(rows, lambda now, new: versioned_upsert(now, new, "workflow_id", "version", F.col("updated_at")))
        if traces is not None:
            self.append_traces(traces)

    def load(self, ids: DataFrame) -> DataFrame:
        return self.states.read().join(ids.select("workflow_id").distinct(), "workflow_id", "left_semi")

    def scan(self, prefix: str, path: str | None = None, value: str | None = None) -> DataFrame:
        """States whose workflow starts with the prefix, and, with a path, whose data hold the value there."""
        d = self.states.read().where(F.col("workflow_id").startswith(prefix))
        return d if path is None else d.where(at_path("data", path) == value)

    # -- traces --

    def append_traces(self, rows: DataFrame, basis_points: int = 10_000) -> None:
        """Adds traces, those of a sample of events only if basis_points is below 10 000; which events is a function of their id."""
        if basis_points < 10_000:
            rows = rows.where(sampled(F.col("event_id"), basis_points))
        self.traces.append(rows)

    def trace_of_event(self, event_id: str) -> DataFrame:
        return self.traces.read().where(F.col("event_id") == event_id).orderBy("ts")

    def trace_of_workflow(self, workflow_id: str, limit: int) -> DataFrame:
        return self.traces.read().where(F.col("workflow_id") == workflow_id).orderBy(F.desc("ts")).limit(limit)

    def recent_events(self, limit: int) -> DataFrame:
        return self.traces.read().where(F.col("stage").isin(*TERMINAL)).orderBy(F.desc("ts")).limit(limit)

    def traces_since(self, ts: str, cap: int = 20_000) -> DataFrame:
        return self.traces.read().where(F.col("ts") >= F.lit(ts).cast("timestamp")).orderBy(F.desc("ts")).limit(cap)

    def scan_traces(self, prefix: str, stage: str) -> DataFrame:
        return self.traces.read().where(F.col("event_id").startswith(prefix) & (F.col("stage") == stage))

    # -- purge --

    def purge(self, sm_types: Sequence[str], prefixes: Sequence[str], stream: str) -> int:
        """A flow's states, its traces and its stream's checkpoints go; returns how many rows."""
        of_flow = lambda c: F.coalesce(F.array_contains(F.array(*[F.col(c).startswith(p) for p in prefixes]), True), F.lit(False)) if prefixes else F.lit(False)
        mine = {
            self.states: F.col("sm_type").isin(list(sm_types)) | of_flow("workflow_id"),
            self.traces: of_flow("workflow_id"),
            self.checkpoints: F.col("stream") == stream,
        }
        gone = 0
        for t, cond in mine.items():
            cond = F.coalesce(cond, F.lit(False))
            old = t.read().where(cond)
            n = old.count()
            if n:
                t.apply(old, lambda now, _, cond=cond: now.where(~cond))
            gone += n
        return gone


class TraceWriter:
    """Traces one by one, written in batches: when `batch` of them wait, or the oldest has waited for `wait_ms`. Beyond `most` waiting ones new traces are dropped and counted, so that tracing never holds up what is traced."""

    def __init__(self, store: StateStore, batch: int = 500, wait_ms: int = 50, most: int = 100_000, basis_points: int = 10_000, clock: Callable[[], float] = time.monotonic) -> None:
        self.store, self.batch, self.wait_ms, self.most, self.basis_points, self.clock = store, batch, wait_ms, most, basis_points, clock
        self.waiting: list[tuple] = []
        self.since: float | None = None
        self.dropped = 0

    def offer(self, *row: object) -> bool:
        """A row as TRACE names it. False if it was dropped."""
        if len(self.waiting) >= self.most:
            self.dropped += 1
            return False
        self.since = self.clock() if self.since is None else self.since
        self.waiting.append(row)
        return True

    def due(self) -> bool:
        return len(self.waiting) >= self.batch or (self.since is not None and (self.clock() - self.since) * 1000 >= self.wait_ms)

    def flush(self) -> int:
        """Writes all that wait; what can't be written waits on. Returns how many were written."""
        rows = list(self.waiting)
        if rows:
            self.store.append_traces(self.store.spark.createDataFrame(rows, TRACE), self.basis_points)
            del self.waiting[: len(rows)]
        self.since = self.clock() if self.waiting else None
        return len(rows)

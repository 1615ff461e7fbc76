"""Events with handlers: keyed state, emitted events, timers, errors that block or are parked.

Events that share a key must be applied one after the other, in order; others needn't wait. In
each round the pending events and the states they may touch fall into connected components of
shared keys. A component's states and then its events, in order, stream through one task, which
holds its states and one event at a time: events that share keys can't be applied otherwise, but
however many there are they needn't fit in memory. Emitted events make the next round, until none
is due.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.session import materialize

EVENTS = "event_id string, event_type string, payload string, seq bigint, due_ms bigint, parent string, root string, depth int"
OUTCOMES = "event_id string, event_type string, status string, error string, attempts int, parent string, root string, depth int, children array<string>, round int"
STATES = "key string, doc string, version bigint"
_OUT = "kind string, id string, body string"
#: Rows a task hands on at once.
_ROWS = 5_000


class Blocking(Exception):
    """The event's keys stay held until someone decides."""


class Rejected(Exception):
    """The event is done, without any effect; its message is the outcome."""


@dataclass(frozen=True)
class Handler:
    """apply(payload, ctx) may read and save states of the event's keys and emit events; only a success counts."""

    apply: Callable[[dict, Context], None]
    domain: str
    locks: tuple[str, ...] = ()
    retries: int = 0
    on_error: str = "park"  # or block
    check: Callable[[dict], Sequence[str]] | None = None  # what of a payload doesn't fit; anything rejects it


@dataclass
class Context:
    event_id: str
    keys: tuple[str, ...]
    states: dict[str, dict]
    saved: dict[str, dict] = field(default_factory=dict)
    emitted: list[tuple[str, dict, int]] = field(default_factory=list)
    attempt: int = 1

    def state(self, key: str) -> dict | None:
        return self.saved.get(key) or self.states.get(key)

    def save(self, key: str, doc: dict) -> None:
        if key not in self.keys:
            raise ValueError(f"{key} isn't held by {self.event_id}")
        self.saved[key] = doc

    def emit(self, event_type: str, payload: dict, at_ms: int = 0) -> None:
        self.emitted.append((event_type, payload, at_ms))


def lock_keys(templates: tuple[str, ...], payload: dict, domain: str, event_id: str) -> tuple[str, ...]:
    """The keys of an event, sorted and distinct; `{field}` is read from the payload's top level, where it must be present. Without templates the event has a key of its own."""

    def fill(t: str) -> str:
        def one(m: re.Match) -> str:
            v = payload.get(m.group(1))
            if v is None or str(v).strip() == "":
                raise Rejected(f"no {m.group(1)} for {t}")
            return str(v)

        return re.sub(r"\{(\w+)\}", one, t)

    return tuple(sorted({fill(t) for t in templates})) or (f"{domain}:{event_id}",)


def components(links: DataFrame) -> DataFrame:
    """(event_id, key) links to (event_id, label): equal for events that share keys, directly or through others. Labels are the smallest event id, found by passing minima back and forth."""
    label = materialize(links.groupBy("event_id").agg(F.min("event_id").alias("label")), "labels")
    while True:
        by_key = links.join(label, "event_id").groupBy("key").agg(F.min("label").alias("label"))
        nxt = materialize(links.join(by_key, "key").groupBy("event_id").agg(F.min("label").alias("label")), "labels")
        if nxt.join(label, ["event_id", "label"], "left_anti").isEmpty():
            return nxt
        # Labels point to events that may have better labels by now: jump there.
        jump = nxt.select(F.col("event_id").alias("label"), F.col("label").alias("better"))
        label = materialize(nxt.join(jump, "label", "left").select("event_id", F.least("label", F.coalesce("better", "label")).alias("label")), "labels")


_TASK = "label string, what int, seq bigint, event_id string, key string, doc string, version bigint, event_type string, payload string, keys array<string>, parent string, root string, depth int"


class _Component:
    """The states of one component, and what becomes of its events one after the other."""

    def __init__(self, handlers: Mapping[str, Handler], number: int) -> None:
        self.handlers, self.number = handlers, number
        self.docs: dict[str, dict] = {}
        self.versions: dict[str, int] = {}
        self.touched: set[str] = set()
        self.held: set[str] = set()

    def state(self, key: str, doc: str, version: int) -> None:
        self.docs[key], self.versions[key] = json.loads(doc), int(version)
        if self.docs[key].get("__held"):
            self.held.add(key)

    def event(self, e) -> Iterator[tuple[str, str, str]]:  # noqa: ANN001
        h = self.handlers.get(e.event_type)
        status, error, attempts, children = "DONE", None, 0, []
        try:
            payload = json.loads(e.payload)
            if not isinstance(payload, dict):
                raise ValueError("the payload is no object")
        except (TypeError, ValueError) as x:
            payload, status, error = {}, "REJECTED", str(x)
        if status == "DONE" and h is None:
            status, error = "REJECTED", f"no handler for {e.event_type}"
        elif status == "DONE" and h.check is not None and (wrong := list(h.check(payload))):
            status, error = "REJECTED", "; ".join(wrong)
        keys = tuple(e.keys)
        if status == "DONE" and self.held & set(keys):
            yield "waiting", e.event_id, ""
            return
        while status == "DONE":
            attempts += 1
            ctx = Context(e.event_id, keys, self.docs, attempt=attempts)
            try:
                h.apply(payload, ctx)
            except Rejected as x:
                status, error = "REJECTED", str(x)
            except Blocking as x:
                status, error = "BLOCKED", str(x)
            except Exception as x:  # noqa: BLE001 (whatever a handler raises is the event's failure)
                error = f"{type(x).__name__}: {x}"
                if attempts > h.retries:
                    status = "BLOCKED" if h.on_error == "block" else "PARKED"
                continue
            else:
                error = None
                for k, d in ctx.saved.items():
                    self.docs[k] = d
                    self.versions[k] = self.versions.get(k, 0) + 1
                    self.touched.add(k)
                for n, (kind, body, at) in enumerate(ctx.emitted, 1):
                    children.append(f"{e.event_id}.{n}")
                    child = {"event_id": children[-1], "event_type": kind, "payload": json.dumps(body), "seq": int(e.seq), "due_ms": at, "parent": e.event_id, "root": e.root or e.event_id, "depth": int(e.depth) + 1}
                    yield "child", children[-1], json.dumps(child)
            break
        if status == "BLOCKED":
            for k in keys:
                self.held.add(k)
                self.docs[k] = self.docs.get(k, {}) | {"__held": e.event_id}
                self.touched.add(k)
        yield "outcome", e.event_id, json.dumps({"event_id": e.event_id, "event_type": e.event_type, "status": status, "error": error, "attempts": attempts, "parent": e.parent, "root": e.root or e.event_id, "depth": int(e.depth), "children": children, "round": self.number})

    def end(self) -> Iterator[tuple[str, str, str]]:
        for k in sorted(self.touched):
            yield "state", k, json.dumps({"key": k, "doc": json.dumps(self.docs[k]), "version": int(self.versions.get(k, 0))})


def _run(handlers: Mapping[str, Handler], number: int):  # noqa: ANN202
    def told(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, str, str]]:
        label, at = None, None
        for f in frames:
            for r in f.itertuples(index=False):
                if at is None or r.label != label:
                    if at is not None:
                        yield from at.end()
                    label, at = r.label, _Component(handlers, number)
                if r.what == 0:
                    at.state(r.key, r.doc, r.version)
                else:
                    yield from at.event(r)
        if at is not None:
            yield from at.end()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = told(frames)
        while part := list(islice(rows, _ROWS)):
            yield pd.DataFrame(part, columns=["kind", "id", "body"])

    return run


def _keys(handlers: Mapping[str, Handler]) -> tuple[Column, Column]:
    """(keys, error) of an event: `lock_keys` as expressions over event_type, payload and event_id. Events that can't be read or have no handler hold a key of their own."""
    own = F.array(F.concat(F.lit("event:"), F.col("event_id")))
    keys, error = own, F.lit(None).cast("string")
    readable = F.schema_of_variant(F.try_parse_json(F.when(F.trim("payload") != "", F.col("payload")))).startswith("OBJECT")
    for kind, h in handlers.items():
        filled, missing = [], []
        for t in h.locks:
            parts = []
            for i, x in enumerate(re.split(r"\{(\w+)\}", t)):
                if i % 2:
                    v = F.get_json_object("payload", f"$.{x}")
                    missing.append(F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.lit(f"no {x} for {t}")))
                    parts.append(v)
                elif x:
                    parts.append(F.lit(x))
            filled.append(F.concat(*parts))
        mine = F.array_sort(F.array_distinct(F.array(*filled))) if filled else F.array(F.concat(F.lit(f"{h.domain}:"), F.col("event_id")))
        bad = F.coalesce(*missing) if missing else F.lit(None).cast("string")
        here = (F.col("event_type") == kind) & readable
        keys = F.when(here & bad.isNull(), mine).otherwise(keys)
        error = F.when(here, bad).otherwise(error)
    return keys, error


def run_flows(events: DataFrame, states: DataFrame, handlers: Mapping[str, Handler], now_ms: int, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, states, left): what became of each event and of those it caused, the states afterwards, and the events that wait for their time or for a held key.

    events: as EVENTS (seq orders them), deduplicated by id; states: as STATES, possibly with held
    keys. An event that can't be read, has no handler or lacks a key's field is REJECTED. An empty
    table gives empty results. After max_rounds whatever is still pending is left.
    """
    spark = events.sparkSession
    known = dict(handlers)
    keys, error = _keys(known)
    pending, left, done = events.select(*[c.split()[0] for c in EVENTS.split(", ")]), [], []
    for number in range(max_rounds):
        pending = materialize(pending.withColumn("k", F.struct(keys.alias("keys"), error.alias("error"))), "pending")
        left.append(pending.where(F.col("due_ms") > now_ms).drop("k"))
        due = pending.where(F.coalesce("due_ms", F.lit(0)) <= now_ms)
        if due.isEmpty():
            break
        unkeyed = due.where("k.error is not null")
        done.append(unkeyed.select("event_id", "event_type", F.lit("REJECTED").alias("status"), F.col("k.error").alias("error"), F.lit(0).alias("attempts"), "parent", F.coalesce("root", "event_id").alias("root"), "depth", F.array().cast("array<string>").alias("children"), F.lit(number).alias("round")))
        go = due.where("k.error is null").withColumn("keys", F.col("k.keys")).drop("k")
        links = go.select("event_id", F.explode("keys").alias("key"))
        label = components(links)
        of_key = links.join(label, "event_id").select("key", F.col("label").alias("of")).distinct()
        mine = states.join(of_key, "key")
        empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _TASK.split(", ")]
        as_task = lambda d, **cols: d.select(*[cols.get(c.split()[0], e).alias(c.split()[0]) for c, e in zip(_TASK.split(", "), empty)])
        col = F.col
        held = as_task(mine, label=col("of"), what=F.lit(0), key=col("key"), doc=col("doc"), version=col("version"))
        queue = as_task(go.join(label, "event_id"), label=col("label"), what=F.lit(1), **{c: col(c) for c in ("seq", "event_id", "event_type", "payload", "keys", "parent", "root", "depth")})
        stream = held.unionByName(queue).repartition("label").sortWithinPartitions("label", "what", "seq", "event_id")
        got = materialize(stream.mapInPandas(_run(known, number), _OUT), "round")
        parse = lambda kind, ddl: got.where(F.col("kind") == kind).select(F.from_json("body", ddl).alias("x")).select("x.*")  # noqa: B023, E731
        done.append(parse("outcome", OUTCOMES))
        fresh = parse("state", STATES)
        states = materialize(states.join(fresh.select("key"), "key", "left_anti").unionByName(fresh), "states")
        left.append(go.join(got.where("kind = 'waiting'").select(F.col("id").alias("event_id")), "event_id", "left_semi").drop("keys"))
        pending = parse("child", EVENTS)
    else:
        left.append(pending)

    def union(parts: list[DataFrame], ddl: str) -> DataFrame:
        out = spark.createDataFrame([], ddl)
        for p in parts:
            out = out.unionByName(p)
        return out

    return union(done, OUTCOMES), states, union(left, EVENTS)


def decide(states: DataFrame, event_id: str) -> DataFrame:
    """The states after an operator has skipped a blocked event: its keys are free again."""
    doc = F.from_json("doc", "map<string,string>")
    free = F.regexp_replace("doc", r',?\s*"__held"\s*:\s*"[^"]*"', "")
    return states.withColumn("doc", F.when(F.element_at(doc, "__held") == event_id, free).otherwise(F.col("doc")))

"""Events of instances that walk through a machine to one of its ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators.machine_fold import Transitions

#: Ways that are told apart at most, and steps of a way; steps taken where no end can be reached.
MOST, LONGEST, ASTRAY = 50, 11, 5
#: What an injected event is called.
INVALID = "__invalid"


def ways(spec: Transitions, most: int = MOST, longest: int = LONGEST) -> list[list[str]]:
    """The events of every way from the initial state to a terminal one that visits no state twice, longest first; where there is none, one of a few first steps."""
    out: list[list[str]] = []
    steps = {}
    for (a, e), b in spec.edges.items():
        steps.setdefault(a, []).append((e, b))
    todo = [(spec.initial, (), frozenset([spec.initial]))]
    while todo and len(out) < most:
        at, way, seen = todo.pop()
        if way and at in spec.terminals:
            out.append(list(way))
        elif len(way) < longest:
            todo += [(b, (*way, e), seen | {b}) for e, b in reversed(steps.get(at, [])) if b not in seen]
    if not out:
        at, way = spec.initial, []
        while at in steps and len(way) < ASTRAY:
            e, at = steps[at][0]
            way.append(e)
        out = [way] if way else []
    return sorted(out, key=len, reverse=True)


def events(spark: SparkSession, spec: Transitions, kind: str, instances: int, *, start_ms: int = 0, per_second: float = 10.0, step_ms: int = 500, invalid_every: int = 0, sample: str = '{"id": "{key}"}') -> DataFrame:
    """(event_id, sm_type, instance_key, event_type, payload, seq, due_ms): instances begin per_second, rotate through the ways, and send an event every step_ms.

    payload is the sample with {key} and {step} filled in. Of every invalid_every-th instance the
    second event is preceded by one that no state takes.
    """
    found = ways(spec)
    if not found:
        return spark.createDataFrame([], "event_id string, sm_type string, instance_key string, event_type string, payload string, seq bigint, due_ms bigint")
    way = F.element_at(F.array(*[F.array(*[F.lit(e) for e in w]) for w in found]), (F.col("id") % len(found)).cast("int") + 1)
    if invalid_every:
        hit = F.col("id") % invalid_every == invalid_every - 1
        way = F.when(hit, F.concat(F.slice(way, 1, 1), F.array(F.lit(INVALID)), F.slice(way, 2, LONGEST))).otherwise(way)
    d = spark.range(instances).select("id", F.posexplode(way).alias("step", "event_type"))
    key = F.concat(F.lit(f"{kind}-"), F.col("id"))
    payload = F.replace(F.replace(F.lit(sample), F.lit("{key}"), key), F.lit("{step}"), F.col("step").cast("string"))
    due = F.lit(start_ms) + F.floor(F.col("id") * (1000 / per_second)) + F.col("step") * step_ms
    return d.select(F.concat(key, F.lit("-"), "step").alias("event_id"), F.lit(kind).alias("sm_type"), key.alias("instance_key"), "event_type", payload.alias("payload"), F.col("step").cast("bigint").alias("seq"), due.cast("bigint").alias("due_ms"))

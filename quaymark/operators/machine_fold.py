"""State machines run over event logs.

An event maps each state to the next (or to itself: rejected), so a stretch of events is a map
from the state before it to the state after it, and maps compose. A key's log is cut into blocks
of its order; each block becomes a map, the maps of a key are run through, and with the state at
its start each block says what became of each of its events. No task needs a key's whole log.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def composed(to: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's map (rows x states) after those of the rows before it in its stretch, and the counts along the way; stretches begin where `first` is set.

    Stretches double in each round: a row takes in the row as far before it as it has taken in already.
    """
    to, counts, whole = to.copy(), counts.copy(), first.copy()
    whole[:1] = True
    step = 1
    while not whole.all():
        at = np.flatnonzero(~whole)
        before = at - step
        via = to[before]
        counts[at] = counts[before] + np.take_along_axis(counts[at], via, 1)
        to[at] = np.take_along_axis(to[at], via, 1)
        whole[at] = whole[before]
        step *= 2
    return to, counts


@dataclass(frozen=True)
class Transitions:
    """(state, event) to the next state; initial state; terminal states."""

    initial: str
    edges: dict[tuple[str, str], str]
    terminals: frozenset[str] = frozenset()

    @property
    def states(self) -> list[str]:
        out = [self.initial]
        for (a, _), b in self.edges.items():
            out += [s for s in (a, b) if s not in out]
        return out

    @classmethod
    def parse(cls, initial: str, text: str, terminals: Sequence[str] = ()) -> Transitions:
        """`A -event-> B; ...`; states without a way out are terminal."""
        import re

        edges = {}
        for m in re.finditer(r"(\w+)\s*-(\w+)->\s*(\w+)", text):
            edges[m.group(1), m.group(2)] = m.group(3)
        ends = {b for b in edges.values()} - {a for a, _ in edges}
        return cls(initial, edges, frozenset(ends | set(terminals)))


def replay(events: DataFrame, key: Column, event: Column, order: Sequence[Column], block: Column, spec: Transitions, event_id: Column) -> DataFrame:
    """(key, event_id, event, from_state, to_state, outcome, version): what became of each event, in order.

    outcome is ACCEPTED, TERMINAL (accepted into a terminal state) or REJECTED (no edge: nothing
    changes); version counts the accepted events. block: cuts each key's order into stretches, and
    must not decrease along it. Events with null key are left out, a null event is rejected. `order`
    must be total for the result to be repeatable. Events that repeat an id are events of their own:
    deduplicate first.
    """
    states = spec.states
    size = len(states)
    place = {s: i for i, s in enumerate(states)}
    names = sorted({e for _, e in spec.edges})
    # The map of each event: state to state, and whether it counts; the last row is that of unknown events.
    to = np.tile(np.arange(size), (len(names) + 1, 1))
    counts = np.zeros((len(names) + 1, size), np.int64)
    for (a, e), b in spec.edges.items():
        to[names.index(e), place[a]] = place[b]
        counts[names.index(e), place[a]] = 1
    ends = np.isin(np.arange(size), [place[s] for s in spec.terminals if s in place])
    code = F.lit(len(names))
    for i, e in enumerate(names):
        code = F.when(F.col("event") == e, F.lit(i)).otherwise(code)
    d = events.select(key.cast("string").alias("key"), event.cast("string").alias("event"), event_id.cast("string").alias("event_id"), F.coalesce(block.cast("bigint"), F.lit(-(2**62))).alias("block"), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("o")).where("key is not null").withColumn("code", code)

    def through(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
        """Of sorted rows: the frame, where new (key, block) stretches begin, and each row's map and counts from the stretch's start up to the row itself."""
        last, held = None, None
        for f in frames:
            if not len(f):
                continue
            k, b = f["key"].to_numpy(object), f["block"].to_numpy()
            first = np.empty(len(f), bool)
            first[0] = (k[0], b[0]) != last
            first[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
            c = f["code"].to_numpy()
            at, n = composed(to[c], counts[c], first)
            if not first[0]:  # the stretch began in a frame before
                z = len(f) if not first.any() else int(first.argmax())
                n[:z] = held[1] + n[:z][:, held[0]]
                at[:z] = at[:z][:, held[0]]
            last, held = (k[-1], b[-1]), (at[-1].copy(), n[-1].copy())
            yield f, first, at, n

    def compose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: tuple | None = None
        for f, first, at, n in through(frames):
            begins = np.flatnonzero(first)
            if open_ is not None and first[0]:
                yield pd.DataFrame([open_], columns=["key", "block", "to", "n"])
            ends_at = np.append(begins[1:] - 1, len(f) - 1) if len(begins) else np.array([len(f) - 1])
            if len(begins) and begins[0] > 0:
                ends_at = np.append(begins[0] - 1, ends_at)
            rows = list(zip(f["key"].to_numpy(object)[ends_at], f["block"].to_numpy()[ends_at].tolist(), at[ends_at].tolist(), n[ends_at].tolist()))
            open_ = rows.pop()  # may go on in the next frame
            if rows:
                yield pd.DataFrame(rows, columns=["key", "block", "to", "n"])
        if open_ is not None:
            yield pd.DataFrame([open_], columns=["key", "block", "to", "n"])

    ranked = d.repartition("key", "block").sortWithinPartitions("key", "block", "o").drop("o")
    maps = ranked.select("key", "block", "code").mapInPandas(compose, "key string, block bigint, to array<int>, n array<bigint>")
    # A key's maps, one small row per block, run through once.
    def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s, v = None, 0, 0
        for f in frames:
            at = []
            for row in f.itertuples(index=False):
                if row.key != key:
                    key, s, v = row.key, place[spec.initial], 0
                at.append((row.key, row.block, s, v))
                s, v = int(row.to[s]), v + int(row.n[s])
            yield pd.DataFrame(at, columns=["key", "block", "s", "v"])

    start = maps.repartition("key").sortWithinPartitions("key", "block").mapInPandas(starts, "key string, block bigint, s int, v bigint")

    def tell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, last = np.asarray(states, object), 0
        for f, first, at, n in through(frames):
            s, row = f["s"].to_numpy(), np.arange(len(f))
            after, version = at[row, s], f["v"].to_numpy() + n[row, s]
            before = np.where(first, s, np.concatenate([[last], after[:-1]]))
            last = after[-1]
            good = counts[f["code"].to_numpy(), before] > 0
            outcome = np.where(~good, "REJECTED", np.where(ends[after], "TERMINAL", "ACCEPTED"))
            yield pd.DataFrame({"key": f["key"], "event_id": f["event_id"], "event": f["event"], "from_state": label[before], "to_state": label[after], "outcome": outcome, "version": version})

    told = d.join(start, ["key", "block"]).repartition("key", "block").sortWithinPartitions("key", "block", "o").drop("o")
    return told.mapInPandas(tell, "key string, event_id string, event string, from_state string, to_state string, outcome string, version bigint")


def entities(told: DataFrame) -> DataFrame:
    """(key, state, version, last_event_id): the entities after a replay; those that accepted nothing aren't there."""
    good = told.where("outcome <> 'REJECTED'")
    return good.groupBy("key").agg(F.max_by(F.struct("to_state", "event_id"), "version").alias("m"), F.max("version").alias("version")).select("key", F.col("m.to_state").alias("state"), "version", F.col("m.event_id").alias("last_event_id"))


def streaming_fold(spec: Transitions, event: str, order: str, idle_ms: int | None = None):  # noqa: ANN201
    """The same machine for `groupBy(key).applyInPandasWithState`: (function, output schema, state schema). A micro-batch's events of a key are taken in its order; idle_ms without any ends the key's state."""
    held = T.StructType([T.StructField("state", T.StringType()), T.StructField("version", T.LongType()), T.StructField("rejected", T.LongType())])
    out = T.StructType([T.StructField("key", T.StringType()), *held.fields, T.StructField("expired", T.BooleanType())])

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        s, v, bad = state.get if state.exists else (spec.initial, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "state": [s], "version": [v], "rejected": [bad], "expired": [True]})
            return
        rows = pd.concat(list(frames))
        for e in rows.sort_values(order, kind="stable")[event]:
            t = spec.edges.get((s, e))
            if t is None:
                bad += 1
            else:
                s, v = t, v + 1
        state.update((s, v, bad))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"key": [k[0]], "state": [s], "version": [v], "rejected": [bad], "expired": [False]})

    return fold, out, held

"""Percentiles with bounded error, from summaries that can be combined.

A summary holds some of the values, each with the lowest and highest rank it can have among all
(v, lo, hi). A summary of values in hand is exact; merging adds the rank bounds that the other
summaries leave open, which makes their shares of error no larger than the largest among them;
compressing drops values as long as no answer can be off by more than the ranks permitted.

`epsilon` is the share of n that an answer's rank may be off. It is spent in equal steps, one per
level of merging: summaries of equal level are merged WIDE at a time, the result may be off by one
step more, and past the last level nothing more is permitted, so that the bound holds however
many rows, tasks, days or slices come together. The error reported is the one actually left.

Partitions summarise their own rows, so a group that holds a third of all rows sends a summary
per task. Summaries are merged in two levels of at most FAN tasks each, then by group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The share of n that the rank of an answer may be off, unless a caller asks for another.
EPSILON = 0.005
#: Levels of merging within a task and after it; summaries of one level that are merged together.
TASK_LEVELS, LEVELS, WIDE = 6, 8, 32
#: Summaries merged by one task of the first level.
FAN = 64
#: Tuples a task holds before it passes its summaries on.
HELD = 2_000_000

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def permitted(epsilon: float, level: int) -> float:
    """The share of n that a summary of this level may be off."""
    if not 0 < epsilon < 1:
        raise ValueError("epsilon lies between 0 and 1")
    return epsilon * min(level, LEVELS) / LEVELS


def exact(values: np.ndarray) -> Summary:
    v = np.sort(np.asarray(values, np.float64))
    r = np.arange(1, len(v) + 1, dtype=np.int64)
    return v, r, r.copy(), len(v)


def compress(s: Summary, share: float) -> Summary:
    """As few tuples, the ends among them, as leave no answer off by more than share * n ranks (or than it was)."""
    v, lo, hi, n = s
    ranks = int(share * n)
    if ranks < 1 or len(v) < 3:
        return s
    # From each tuple to the farthest one that leaves at most 2 * ranks open between them.
    reach = np.maximum(np.searchsorted(hi, lo + 2 * ranks, "right") - 1, np.arange(1, len(v) + 1)).tolist()
    at, last = [0], len(v) - 1
    while at[-1] < last:
        at.append(min(reach[at[-1]], last))
    keep = np.asarray(at)
    return v[keep], lo[keep], hi[keep], n


def merge(parts: Sequence[Summary], share: float = 0.0) -> Summary:
    """One summary of all that the parts stand for, off by at most `share` of n, or by the largest share of a part."""
    parts = [p for p in parts if p[3]]
    if not parts:
        return exact(np.empty(0))
    if len(parts) == 1:
        return compress(parts[0], share)
    v = np.concatenate([p[0] for p in parts])
    lo, hi = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    src = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    n = sum(p[3] for p in parts)
    for k, (pv, plo, phi, pn) in enumerate(parts):
        other = src != k
        x = v[other]
        # Of equal values those of earlier parts stand before those of later ones, so every rank is held once.
        first = np.where(src[other] > k, np.searchsorted(pv, x, "right"), np.searchsorted(pv, x, "left"))
        lo[other] += np.concatenate([[0], plo])[first]
        hi[other] += np.concatenate([phi - 1, [pn]])[first]
    order = np.lexsort((src, v))
    return compress((v[order], lo[order], hi[order], n), share)


def rank_error(s: Summary) -> int:
    """How many ranks an answer can be off at most."""
    v, lo, hi, n = s
    if not n:
        return 0
    # A rank between two tuples' middles is answered by the nearer one; beyond the ends by the end.
    gaps = np.concatenate([[hi[0] - 1], (hi[1:] - lo[:-1]) // 2 if len(v) > 1 else [], [n - lo[-1]]])
    # Between exact neighbours of consecutive ranks nothing is left open.
    return int(0 if np.array_equal(lo, hi) and len(v) == n else gaps.max())


def quantile(s: Summary, p: float) -> float | None:
    """A value whose rank is within rank_error of ceil(p n)."""
    v, lo, hi, n = s
    if not n:
        return None
    r = min(max(int(np.ceil(p * n)), 1), n)
    return float(v[np.argmin(np.maximum(hi - r, r - lo))])


_FIELDS = [("_v", pa.list_(pa.float64())), ("_lo", pa.list_(pa.int64())), ("_hi", pa.list_(pa.int64())), ("_n", pa.int64())]
_DDL = "_v array<double>, _lo array<bigint>, _hi array<bigint>, _n bigint"


def _ddl(df: DataFrame, by: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{b}` {kinds[b]}, " for b in by)


class _Stack:
    """The summaries of one group in a task, by level: WIDE of one level become one of the next."""

    def __init__(self, epsilon: float) -> None:
        self.epsilon = epsilon
        self.levels: list[list[Summary]] = [[]]

    def add(self, s: Summary) -> int:
        """Returns by how many the tuples held grow."""
        self.levels[0].append(s)
        grown, k = len(s[0]), 0
        while len(self.levels[k]) >= WIDE:
            if k + 1 == len(self.levels):
                self.levels.append([])
            one = merge(self.levels[k], permitted(self.epsilon, min(k + 1, TASK_LEVELS)))
            grown += len(one[0]) - sum(len(x[0]) for x in self.levels[k])
            self.levels[k] = []
            self.levels[k + 1].append(one)
            k += 1
        return grown

    def all(self) -> Summary:
        return merge([s for level in self.levels for s in level], permitted(self.epsilon, TASK_LEVELS))


def summarize(df: DataFrame, by: Sequence[str], value: str, epsilon: float = EPSILON) -> DataFrame:
    """Summaries (by..., _slice, _v, _lo, _hi, _n) of the values of each group, one or more per group and task.

    Nulls, NaN and infinite values are no values; groups without values give no row, a null in
    `by` is a group. Other columns aren't read. An answer from them, or from what `combine` makes
    of them with the same epsilon, is off by at most epsilon * n ranks.
    """
    by = list(by)
    permitted(epsilon, 1)
    d = df.select(*[F.col(f"`{b}`") for b in by], F.col(f"`{value}`").cast("double").alias("__v")).where("__v is not null and not isnan(__v) and abs(__v) < double('Infinity')")
    kinds = {f.name: f.dataType for f in d.schema.fields}
    out = _ddl(d, by) + "_slice int, " + _DDL
    from pyspark.sql.pandas.types import to_arrow_type

    key_types = [(b, to_arrow_type(kinds[b])) for b in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, _Stack] = {}
        tuples = 0

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                keys, ss = list(held), [x.all() for x in held.values()]
                cols = [pa.array([k[i] for k in keys], t) for i, (_, t) in enumerate(key_types)]
                cols += [pa.array([part] * len(keys), pa.int32())] + [pa.array([s[i] for s in ss], t) for i, (_, t) in enumerate(_FIELDS)]
                yield pa.RecordBatch.from_arrays(cols, [b for b, _ in key_types] + ["_slice"] + [f for f, _ in _FIELDS])
                held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            values = b.column(len(by)).to_numpy(zero_copy_only=False)
            if by:
                t = pa.Table.from_batches([b])
                enc = [c.dictionary_encode(null_encoding="encode").combine_chunks() for c in t.columns[:-1]]
                enc = [e.chunk(0) if isinstance(e, pa.ChunkedArray) else e for e in enc]
                code = np.zeros(b.num_rows, np.int64)
                for e in enc:
                    code = code * len(e.dictionary) + e.indices.to_numpy(zero_copy_only=False)
                order = np.lexsort((values, code))
                code = code[order]
                cuts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                dicts = [e.dictionary.to_pylist() for e in enc]
                idx = [e.indices.to_numpy(zero_copy_only=False) for e in enc]
                keys = [tuple(d[i[order[c]]] for d, i in zip(dicts, idx)) for c in cuts.tolist()]
            else:
                order, cuts, keys = np.argsort(values), np.zeros(1, np.int64), [()]
            ends = np.append(cuts[1:], len(values))
            sorted_values = values[order]
            for k, a, z in zip(keys, cuts.tolist(), ends.tolist()):
                ranks = np.arange(1, z - a + 1, dtype=np.int64)
                s = compress((sorted_values[a:z], ranks, ranks.copy(), z - a), permitted(epsilon, 1))
                mine = held.get(k)
                if mine is None:
                    mine = held[k] = _Stack(epsilon)
                tuples += mine.add(s)
            if tuples > HELD:
                yield from emit()
                tuples = 0
        yield from emit()

    return d.mapInArrow(run, out)


def combine(summaries: DataFrame, by: Sequence[str], epsilon: float = EPSILON, fan: int = FAN) -> DataFrame:
    """Summaries of finer groups, days or partitions merged into one per value of `by`."""
    by = list(by)
    from pyspark.sql import types as T

    def level(d: DataFrame, keys: list[str], number: int) -> DataFrame:
        share = permitted(epsilon, number)
        out = T.StructType([d.schema[k] for k in keys] + [d.schema[c] for c in ("_v", "_lo", "_hi", "_n")])

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            s = merge([(np.asarray(v, np.float64), np.asarray(lo, np.int64), np.asarray(hi, np.int64), int(n)) for v, lo, hi, n in zip(pdf["_v"], pdf["_lo"], pdf["_hi"], pdf["_n"])], share)
            row = {k: [pdf[k].iloc[0]] for k in keys} | {"_v": [s[0]], "_lo": [s[1]], "_hi": [s[2]], "_n": [s[3]]}
            return pd.DataFrame(row)

        return d.groupBy(*keys).applyInPandas(join, out)

    cols = [F.col(f"`{b}`") for b in by]
    first = summaries.select(*cols, F.floor(F.col("_slice") / fan).cast("int").alias("_slice"), "_v", "_lo", "_hi", "_n")
    out = level(first, [*by, "_slice"], LEVELS - 1)
    return level(out, by, LEVELS) if by else level(out.withColumn("__all", F.lit(1)), ["__all"], LEVELS).drop("__all")


def percentiles(summaries: DataFrame, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """(by..., n, p, value, rank_error): rank_error is the share of n that the value's rank can be off at most."""
    by = list(by)
    if {"n", "p", "value", "rank_error"} & set(by):
        raise ValueError("n, p, value and rank_error are names of the result")
    out = _ddl(summaries, by) + "n bigint, p double, value double, rank_error double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ss = [(np.asarray(v, np.float64), np.asarray(lo, np.int64), np.asarray(hi, np.int64), int(n)) for v, lo, hi, n in zip(pdf["_v"], pdf["_lo"], pdf["_hi"], pdf["_n"])]
            rep = pdf[by + ["_n"]].rename(columns={"_n": "n"}).loc[pdf.index.repeat(len(ps))].reset_index(drop=True)
            rep["p"] = list(ps) * len(pdf)
            rep["value"] = [quantile(s, p) for s in ss for p in ps]
            rep["rank_error"] = [rank_error(s) / s[3] for s in ss for _ in ps]
            yield rep

    return summaries.mapInPandas(run, out)

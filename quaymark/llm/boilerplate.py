"""Lines that aren't speech, learned from where they stand.

Adverts come at the beginning and the end of files of many titles; speech opens lines anywhere. For
the first two words of every line it is counted how often they open one, how often at an edge of
the file, and in how many groups of files. All documents are counted; each task sums its own first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.llm.subtitles import EDGE_SHARE, GROUPS, OFTEN, openers_of

#: Openers that the driver takes at most; more are an error. Openers a task holds before it passes them on.
MAX_OPENERS, HELD = 100_000, 500_000


def counted(documents: DataFrame, text: Column, group: Column) -> DataFrame:
    """(opener, n, edge, groups): occurrences, those at an edge, and the smallest hashes of the groups of these, as many as are needed to tell that they are enough; several rows per opener."""
    d = documents.select(text.alias("text"), F.xxhash64(group).alias("g")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def emit() -> pa.RecordBatch:
            rows = list(held.items())
            out = pa.RecordBatch.from_arrays([pa.array([o for o, _ in rows], pa.string()), pa.array([r[0] for _, r in rows], pa.int64()), pa.array([r[1] for _, r in rows], pa.int64()), pa.array([sorted(r[2])[:GROUPS] for _, r in rows], pa.list_(pa.int64()))], ["opener", "n", "edge", "groups"])
            held.clear()
            return out

        for b in batches:
            for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for o, edge in openers_of(t):
                    r = held.get(o)
                    if r is None:
                        r = held[o] = [0, 0, set()]
                    r[0] += 1
                    if edge:
                        r[1] += 1
                        if len(r[2]) < GROUPS:
                            r[2].add(g)
            if len(held) > HELD:
                yield emit()
        yield emit()

    return d.mapInArrow(run, "opener string, n bigint, edge bigint, groups array<bigint>")


def openers(documents: DataFrame, text: Column, group: Column) -> frozenset[str]:
    """The openers of lines that stand at the edges of files too often to be speech. group: files that may hold the same text count as one."""
    c = counted(documents, text, group).groupBy("opener").agg(F.sum("n").alias("n"), F.sum("edge").alias("edge"), F.array_distinct(F.flatten(F.collect_list(F.when(F.size("groups") > 0, F.col("groups"))))).alias("groups"))
    found = c.where((F.col("n") >= OFTEN) & (F.col("edge") >= EDGE_SHARE * F.col("n")) & (F.size("groups") >= GROUPS)).select("opener").limit(MAX_OPENERS + 1).collect()
    if len(found) > MAX_OPENERS:
        raise ValueError(f"more than {MAX_OPENERS} openers of adverts")
    return frozenset(r.opener for r in found)

"""Trees given by parent links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.session import materialize


def rooted(links: DataFrame, node: str, parent: str) -> DataFrame:
    """(root, node, depth): every way down from a root (a row whose parent is null) to a row.

    Links double in each round: what points up 2^k steps is joined to what that points at, so the
    rounds grow with the logarithm of the depth and each moves a row once. Rows that lead to no
    root, because a parent isn't there or links go round in a circle, don't come out. A node with
    several parents comes out once per way. Null nodes have no children.
    """
    start = links.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), F.col(node)).alias("root"), F.col(parent).isNotNull().cast("bigint").alias("depth"))
    done = [start.where("up is null").select("root", "node", "depth")]
    open_, reached = start.where("up is not null"), start
    while True:
        # What `up` stands at: a root at last, or another node to go on from.
        ahead = reached.select(F.col("node").alias("at"), F.col("up").alias("next"), F.col("root").alias("found"), F.col("depth").alias("more"))
        moved = materialize(open_.join(ahead, F.col("up") == F.col("at")).select("node", F.col("next").alias("up"), F.col("found").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "links")
        ended = moved.where("up is null")
        if ended.isEmpty():  # a way of any length would have had one end in each round before
            break
        done.append(ended.select("root", "node", "depth"))
        reached = materialize(reached.where("up is null").unionByName(moved), "reached")
        open_ = moved.where("up is not null")
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out

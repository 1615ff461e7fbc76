"""As-of joins: each left row with the last right row of its key at or before it.

Both sides are laid out in buckets of time. Within a bucket one window finds the last right row;
for left rows without one, the last right row of the nearest earlier bucket is carried over from
a table of bucket ends. So the longest sort is that of a key's rows in one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a bucket in microseconds: an hour.
BUCKET_US = 3_600_000_000


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_us: Column, right_us: Column, columns: Sequence[str], *, how: str = "left", tie: Sequence[Column] = (), bucket_us: int = BUCKET_US, strict: bool = False) -> DataFrame:
    """left with the `columns` of the last right row of equal `on` whose time isn't later.

    how: "left" keeps rows without match (nulls), "inner" drops them. tie: orders right rows of one
    time. strict: the right row must be earlier. Times are microseconds; rows with null keys or
    times match nothing. Column names of the right side must not occur on the left, but for `on`.
    """
    names = left.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    mine = F.struct(*[F.col(f"`{c}`") for c in columns])
    order = F.struct(*[t.alias(f"t{i}") for i, t in enumerate(tie)]) if tie else F.lit(0)
    l = left.select(*on, left_us.cast("bigint").alias("__us"), row.alias("__l"))
    r = right.select(*on, right_us.cast("bigint").alias("__us"), mine.alias("__r"), order.alias("__t")).where(F.col("__us").isNotNull())
    for c in on:
        r = r.where(F.col(c).isNotNull())
    bucket = F.floor(F.col("__us") / bucket_us).cast("bigint")
    side = F.lit(0 if strict else 1)
    u = l.withColumn("__side", side).unionByName(r.withColumn("__side", F.lit(1) - side), allowMissingColumns=True).withColumn("__b", bucket)
    keys = [*on, "__b"]
    w = Window.partitionBy(*keys).orderBy("__us", "__side", "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("__hit", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    ends = r.groupBy(*on, bucket.alias("__b")).agg(F.max_by("__r", F.struct("__us", "__t")).alias("__end"))
    # Which left buckets need which earlier end: one row per key and bucket.
    asked = u.where("__hit is null").select(*keys).distinct()
    wb = Window.partitionBy(*on).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    both = ends.select(*keys, "__end").unionByName(asked, allowMissingColumns=True).groupBy(*keys).agg(F.first("__end", ignorenulls=True).alias("__end"))
    carried = both.withColumn("__carry", F.last("__end", ignorenulls=True).over(wb)).select(*keys, "__carry").where("__carry is not null")
    u = u.join(carried, keys, "left").withColumn("__hit", F.coalesce("__hit", "__carry"))
    if how == "inner":
        u = u.where("__hit is not null")
    return u.select(*[F.col("__l")[c].alias(c) for c in names], *[F.col("__hit")[c].alias(c) for c in columns])

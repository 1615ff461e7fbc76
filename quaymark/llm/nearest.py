"""Records of two tables paired with the nearest in time, for the same entity.

Each right-hand record owns the stretch of time in which it is the nearest: from the midpoint
with the one before to the midpoint with the one after, but no farther than the tolerance. These
stretches don't overlap, so a left-hand time falls into one at most. Stretches are indexed by
cells of time whose width is the next of a few powers of two, APART bits from each other, that the
stretch's length doesn't exceed: a stretch touches two cells, a left-hand time probes one cell per
width. No task gets all of an entity: the
neighbours are looked up in buckets of time, with the next buckets' borders beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Narrowest cell, as a power of two of microseconds (2^17 us: about 131 ms).
NARROWEST = 17
#: Bits between one width and the next.
APART = 2


def stretches(right: DataFrame, tolerance_us: int) -> DataFrame:
    """(entity, at, seq) to (entity, seq, lo, hi): the times in [lo, hi] have this record as the nearest within the tolerance.

    At a midpoint the earlier record wins. Records of one time count as one, with the smallest seq.
    """
    width = max(2 * tolerance_us, 1 << NARROWEST)
    one = right.groupBy("entity", "at").agg(F.min("seq").alias("seq"))
    b = one.withColumn("bucket", F.floor(F.col("at") / F.lit(width)).cast("bigint"))
    # Two records that are more than twice the tolerance apart don't limit each other, so only the
    # borders of the buckets before and after matter; a bucket has at most `width` distinct times.
    edges = b.groupBy("entity", "bucket").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    halo = edges.select("entity", F.inline(F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.col("first").alias("at")), F.struct((F.col("bucket") + 1).alias("bucket"), F.col("last").alias("at")))))
    both = b.select("entity", "bucket", "at", "seq", F.lit(True).alias("own")).unionByName(halo.select("entity", "bucket", "at", F.lit(None).cast(one.schema["seq"].dataType).alias("seq"), F.lit(False).alias("own")))
    w = Window.partitionBy("entity", "bucket").orderBy("at")
    before, after, at = F.lag("at").over(w), F.lead("at").over(w), F.col("at")
    near = both.select("entity", "seq", "own", "at", before.alias("b"), after.alias("a")).where("own")
    half = lambda x, y: F.shiftright(x + y, 1)  # noqa: E731 (floor, also below zero)
    lo = F.greatest(at - F.lit(tolerance_us), F.coalesce(half(F.col("b"), at) + F.lit(1), at - F.lit(tolerance_us)))
    hi = F.least(at + F.lit(tolerance_us), F.coalesce(half(at, F.col("a")), at + F.lit(tolerance_us)))
    return near.select("entity", "seq", "at", lo.alias("lo"), hi.alias("hi")).where("lo <= hi")


def nearest_join(left: DataFrame, right: DataFrame, *, entity: Column, at: Column, right_entity: Column, right_at: Column, seq: Column, tolerance_us: int) -> DataFrame:
    """Each left record with the right record of its entity that lies nearest in time, at most tolerance_us away.

    Times are microseconds. Of two equally near the earlier counts, of several at one time the
    smallest seq. Returns the left columns with match_seq, match_at (us) and match_entity; left
    records without match, and records on either side with null entity or time, are left out; left
    rows that repeat stay repeated. Empty tables give an empty result. The right side's columns
    other than these aren't carried, so names can't clash.
    """
    names = left.columns
    widest = max(NARROWEST, (2 * tolerance_us + 1).bit_length())
    r = stretches(right.select(right_entity.alias("entity"), right_at.cast("bigint").alias("at"), seq.alias("seq")).where("entity is not null and at is not null"), tolerance_us)
    length = F.col("hi") - F.col("lo") + 1
    levels = [*range(NARROWEST, widest, APART), widest]
    level = F.lit(widest)
    for k in reversed(levels[:-1]):
        level = F.when(length <= F.lit(1 << k), F.lit(k)).otherwise(level)
    cell = lambda c, k: F.expr(f"shiftright({c}, {k})")
    r = r.withColumn("level", level).withColumn("cell", F.explode(F.sequence(cell("lo", "level"), cell("hi", "level"))))
    # The left columns travel one by one, so that those nobody asks for don't.
    own = {c: f"__left{i}" for i, c in enumerate(names)}
    l = left.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()], entity.alias("entity"), at.cast("bigint").alias("t")).where("entity is not null and t is not null")
    l = l.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("cell", cell("t", "level"))
    hit = l.join(r, ["entity", "level", "cell"]).where("t between lo and hi")
    return hit.select(*[F.col(a).alias(c) for c, a in own.items()], F.col("seq").alias("match_seq"), F.col("at").alias("match_at"), F.col("entity").alias("match_entity"))

"""Inserts, updates and deletes applied in version order, as a signed multiset.

Every change that takes effect adds the image after it with +1 and the image before it with
-1; the base adds its rows with +1. Summed by image, what stays positive is the current table.
Since an image is named by (key, version), late and repeated changes fall into place wherever
they arrive.

The image before a change is that of the change with the next lower version of its key. It is
found in blocks of versions: a window within each (key, block), and one over a key's block
ends, so that no task gets all changes of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def effective_changes(base: DataFrame, changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """The changes that take effect, each with the image before it.

    base: (key, version, row); changes: (key, version, row, live), one per (key, version).
    Returns (key, version, row, live, prior_version, prior_live); prior_version is null where
    the entity was absent and never changed before.
    """
    held = base.select("key", F.col("version").alias("held"))
    after = changes.join(held, "key", "left").where(F.col("held").isNull() | (F.col("version") > F.col("held"))).drop("held")
    both = after.select("key", "version", "row", "live", F.lit(False).alias("is_base")).unionByName(base.select("key", "version", "row", F.lit(True).alias("live"), F.lit(True).alias("is_base")))
    b = both.withColumn("block", F.floor(F.col("version") / F.lit(block)).cast("bigint"))
    # Within a block: at most `block` versions of a key, since each (key, version) is there once.
    w = Window.partitionBy("key", "block").orderBy("version", F.col("is_base").desc())
    image = F.struct("version", "live")
    b = b.withColumn("prior", F.lag(image).over(w)).withColumn("last", F.row_number().over(w) == F.count(F.lit(1)).over(Window.partitionBy("key", "block")))
    # Between blocks: a key's block ends, the versions divided by `block`.
    ends = b.where("last").select("key", "block", image.alias("end"))
    ends = ends.select("key", "block", F.lag("end").over(Window.partitionBy("key").orderBy("block")).alias("carried"))
    b = b.join(ends.where("carried is not null"), ["key", "block"], "left")
    prior = F.coalesce("prior", "carried")
    return b.where(~F.col("is_base")).select("key", "version", "row", "live", prior["version"].alias("prior_version"), prior["live"].alias("prior_live"))


def apply_changes(base: DataFrame, changes: DataFrame, *, key: Column, base_key: Column, version: Column, base_version: Column, deleted: Column, tie: Sequence[Column] = (), columns: Sequence[str] = (), key_name: str = "key", version_name: str = "version", block: int = BLOCK) -> DataFrame:
    """The current state of a table after a change feed.

    key, version, deleted: of a change; version null counts as 0, rows with null key are
    ignored. Changes take effect in order of version; one whose version doesn't exceed the one
    held is void; an absent entity takes any. Of several changes with one version the content
    counts, not the deletion, and of several contents the last by `tie`, then the largest row.
    A base with several rows of a key counts with the highest version. columns: carried along,
    null where a side lacks them. Returns key_name, version_name and the columns; empty inputs
    give what the other side says.
    """
    types = dict(base.dtypes) | dict(changes.dtypes)

    def row(df: DataFrame) -> Column:
        return F.struct(F.lit(1).alias("_"), *[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns])

    ties = F.struct(F.lit(0).alias("_"), *[t.alias(f"t{i}") for i, t in enumerate(tie)])
    c = changes.select(key.alias("key"), F.coalesce(version, F.lit(0)).cast("bigint").alias("version"), (~F.coalesce(deleted, F.lit(False))).alias("live"), row(changes).alias("row"), ties.alias("tie")).where("key is not null")
    if columns or tie:
        c = c.groupBy("key", "version").agg(F.max_by(F.struct("row", "live"), F.struct("live", "tie", F.xxhash64("row"))).alias("m")).select("key", "version", "m.row", "m.live")
    else:  # nothing but the fact is kept: a plain hash aggregate
        c = c.groupBy("key", "version").agg(F.max("live").alias("live")).select("key", "version", F.struct(F.lit(1).alias("_")).alias("row"), "live")
    b = base.select(base_key.alias("key"), F.coalesce(base_version, F.lit(0)).cast("bigint").alias("version"), row(base).alias("row")).where("key is not null")
    b = b.groupBy("key").agg(F.max_by("row", F.struct("version", F.xxhash64("row"))).alias("row"), F.max("version").alias("version")) if columns else b.groupBy("key").agg(F.max("version").alias("version")).withColumn("row", F.struct(F.lit(1).alias("_")))
    b = b.select("key", "version", "row")
    eff = effective_changes(b, c, block)
    none = F.lit(None).cast(b.schema["row"].dataType)
    image = lambda on, v, r, n: F.when(on, F.struct("key", F.col(v).alias("version"), r.alias("row"), F.lit(n).alias("n")))
    signed = F.filter(F.array(image(F.col("live"), "version", F.col("row"), 1), image(F.col("prior_live"), "prior_version", none, -1)), lambda x: x.isNotNull())
    images = b.select("key", "version", "row", F.lit(1).alias("n")).unionByName(eff.select(F.inline(signed)))
    summed = images.groupBy("key", "version").agg(F.sum("n").alias("n"), *([F.first("row", ignorenulls=True).alias("row")] if columns else []))
    return summed.where("n > 0").select(F.col("key").alias(key_name), F.col("version").alias(version_name), *[F.col(f"row.`{x}`").alias(x) for x in columns])

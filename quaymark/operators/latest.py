"""The newest row of each key, and a guard that keeps newer rows from being overwritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], per_key: int = 1) -> DataFrame:
    """The last row of each key by `order` (nulls first), or the last per_key rows.

    The rank is limited before the shuffle already, so a hot key sends few rows. Ties stay open
    unless `order` is total; rows with null keys form a group of their own.
    """
    w = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= per_key).drop("__rank")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], per_key: int = 1) -> DataFrame:
    """The first rows of each key by `order`, nulls last."""
    w = Window.partitionBy(*keys).orderBy(*[o.asc_nulls_last() for o in order])
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= per_key).drop("__rank")


def versioned_upsert(stored: DataFrame, incoming: DataFrame, key: str, version: str, arrival: Column) -> DataFrame:
    """The table after a batch: the batch's highest version per key (ties: the later arrival) replaces a stored row only if its version is higher."""
    new = latest_by(incoming, [key], [F.col(version), arrival]).select(*stored.columns)
    held = stored.select(F.col(key).alias("__k"), F.col(version).alias("__v"))
    fresh = new.join(held, F.col(key).eqNullSafe(F.col("__k")), "left").where(F.col("__v").isNull() | (F.col(version) > F.col("__v"))).drop("__k", "__v")
    kept = stored.join(fresh.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return kept.unionByName(fresh)

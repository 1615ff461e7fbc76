"""Messages delivered more than once: exactly one copy of each stays.

The rows of one identifier are ranked by arrival with a total tie-break and the first
stays. The rank is taken as an ordered minimum, which Spark combines before the shuffle:
an identifier that holds a third of all rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.session import materialize

_KEY, _ORDER, _ROW, _N = "__key", "__order", "__row", "__copies"


def _told_apart(df: DataFrame) -> list[Column]:
    """What of a row its hash is taken from: hashes skip nulls, so those get a sign of their own, and lists and structs are spelled out."""
    out = []
    for c, kind in df.dtypes:
        col = F.col(f"`{c}`")
        if "map<" in kind or "variant" in kind:
            continue
        out += [col.isNull(), F.to_json(F.struct(col.alias("x"))) if "<" in kind else col]
    return out


def keep_first(df: DataFrame, key: Column, order: Sequence[Column], copies: str | None = None, key_name: str | None = None) -> DataFrame:
    """One row per value of `key`: the smallest by `order`, nulls last, then by a hash of the whole row.

    key: the message identifier, already normalised. Rows whose key is null can't be told to
    be copies: each stays as it is. order: arrival time first. copies: name of a column for the
    number of rows the message had (1 for rows without key). key_name: also return the key.
    Ties in `order` are settled by a 128-bit hash of all comparable columns, so any two runs agree
    and a row travels once; equal rows are the same copy. An empty table gives an empty one; column names of the input aren't touched.
    """
    names = df.columns
    rank = [F.struct(o.isNull().alias("n"), o.alias("v")) for o in order]
    rest = _told_apart(df)
    whole = F.struct(*[F.col(f"`{c}`") for c in names])
    keyed = df.select(key.alias(_KEY), F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)], F.xxhash64(*rest).alias("h"), F.xxhash64(F.lit("second"), *rest).alias("g")).alias(_ORDER), whole.alias(_ROW))
    once = keyed.where(F.col(_KEY).isNotNull()).groupBy(_KEY).agg(F.min_by(_ROW, _ORDER).alias(_ROW), F.count(F.lit(1)).alias(_N))
    lone = keyed.where(F.col(_KEY).isNull()).select(_KEY, _ROW, F.lit(1).cast("bigint").alias(_N))
    out = once.select(_KEY, _ROW, _N).unionAll(lone)
    extra = ([F.col(_KEY).alias(key_name)] if key_name else []) + ([F.col(_N).alias(copies)] if copies else [])
    return out.select(*[F.col(_ROW)[c].alias(c) for c in names], *extra)


def unseen(batch: DataFrame, key: Column, seen: DataFrame, seen_key: Column, order: Sequence[Column]) -> DataFrame:
    """The messages of a new batch that the store doesn't hold yet, one copy of each.

    The batch is reduced first, so the anti-join gets each identifier once. Rows without
    identifier pass.
    """
    first = keep_first(batch, key, order, key_name="__id")
    held = seen.select(seen_key.alias("__id")).where(F.col("__id").isNotNull()).distinct()
    return first.join(held, "__id", "left_anti").drop("__id")


def absorb(batches: Sequence[DataFrame], key: Column, order: Sequence[Column]) -> DataFrame:
    """Batches taken in turn, each against all that came before: what a store holds at the end.

    What a batch adds is written once, beside what the batches before it added.
    """
    held = None
    for b in batches:
        new = materialize(keep_first(b, key, order) if held is None else unseen(b, key, held, key, order), "absorbed")
        held = new if held is None else held.unionByName(new)
    if held is None:
        raise ValueError("no batch")
    return held

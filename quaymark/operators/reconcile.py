"""Differences between two copies of a table, by hierarchical checksums.

The keys are laid out on the range of a 64-bit hash, so that ranges hold equal shares of the
keys whatever the keys look like. Of each row only its key, its place on the range and its
checksum go on. From a few large ranges downwards, either side's checksums are summed per range
and the ranges in which they differ are bisected, `STEP` times between two comparisons; what lies
in ranges that agree isn't summed again. At the leaves the keys are compared, and only for keys
whose checksums differ are the rows' fields read, from the tables, and compared one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymark.functions.json_text import canonical_json, same_json
from quaymark.session import materialize

#: Rows a leaf range is meant to hold, and bisections between two comparisons.
LEAF_ROWS = 64
STEP = 8

_SIDES = (0, 1)
#: Values of these types are no larger than a checksum: they travel with it.
_NARROW = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _rows(df: DataFrame, key: Column, version: Column, fields: dict[str, Column]) -> DataFrame:
    """(key, rank, row): rank tells which of a key's rows counts."""
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    d = df.select(key.alias("key"), F.coalesce(version.cast("bigint"), F.lit(-(2**62))).alias("ver"), row.alias("row")).where("key is not null")
    return d.select("key", F.struct("ver", F.xxhash64("row").alias("h")).alias("rank"), "row")


def _narrow(df: DataFrame, fields: dict[str, Column]) -> bool:
    return all(isinstance(f.dataType, _NARROW) for f in df.select(*[c.alias(n) for n, c in fields.items()]).schema)


def _checksums(rows: DataFrame, fields: Sequence[str], json_fields: Sequence[str], side: int, carry: bool) -> DataFrame:
    """(side, key, place, sum[, row]) of the row of the highest version of each key."""
    # xxhash64 skips nulls, so nulls get a spelling of their own and each field its place.
    parts = [F.coalesce(same_json(F.col("row")[n]) if n in json_fields else F.col("row")[n].cast("string"), F.lit("\x00")) for n in fields]
    d = rows.select("key", F.struct("rank", F.xxhash64("key", *parts).alias("sum"), *([F.col("row")] if carry else [])).alias("m")).groupBy("key").agg(F.max("m").alias("m"))
    return d.select(F.lit(side).alias("side"), "key", F.xxhash64(F.lit("place"), "key").alias("place"), F.col("m.sum").alias("sum"), *([F.col("m.row").alias("row")] if carry else []))


def _range(bits: int) -> Column:
    return F.shiftrightunsigned("place", 64 - bits)


def depths(rows: int, leaf_rows: int = LEAF_ROWS, step: int = STEP) -> list[int]:
    """How many bits of the range are told apart at each comparison; the last is that of the leaves."""
    leaf = min(48, max(1, (rows // leaf_rows).bit_length()))
    return [*range(step, leaf, step), leaf]


def within(sides: DataFrame, ranges: DataFrame | None, bits: int) -> DataFrame:
    """What lies in the ranges (all, if None)."""
    return sides if ranges is None else sides.join(ranges.withColumnRenamed("range", "__range"), _range(bits) == F.col("__range"), "left_semi")


def differing_ranges(sides: DataFrame, bits: int) -> DataFrame:
    """The ranges (column range) in which count, exclusive or or sum of the two sides' checksums differ."""
    of = lambda k, c: F.when(F.col("side") == k, c)
    low = F.col("sum").bitwiseAND(F.lit(0xFFFFFFFF))
    figures = [g for k in _SIDES for g in (F.count(of(k, F.lit(1))).alias(f"n{k}"), F.coalesce(F.bit_xor(of(k, F.col("sum"))), F.lit(0)).alias(f"x{k}"), F.coalesce(F.sum(of(k, low)), F.lit(0)).alias(f"s{k}"))]
    return sides.groupBy(_range(bits).alias("range")).agg(*figures).where("n0 <> n1 or x0 <> x1 or s0 <> s1").select("range")


def descend(sides: DataFrame, levels: Sequence[int]) -> DataFrame:
    """What lies in differing leaves: at each level only the ranges left open by the one above are summed."""
    open_, above = None, 0
    for bits in levels:
        sides = within(sides, open_, above)
        open_, above = differing_ranges(sides, bits), bits
    return within(sides, open_, above)


def reconcile(left: DataFrame, right: DataFrame, *, key: Column, version: Column, fields: dict[str, Column], json_fields: Sequence[str] = (), missing_right: str | None = "missing_right", missing_left: str | None = "missing_left", right_key: Column | None = None, right_version: Column | None = None, right_fields: dict[str, Column] | None = None, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Rows (key, finding): a key that one side lacks, or the name of a field that differs.

    Of several rows of a key the highest version counts (null the lowest), then the row with the
    largest hash; rows with null key are ignored. Fields compare null-safe; those in json_fields
    as JSON values, whatever their spelling, numbers exactly; text that isn't JSON as it is. A
    finding named None isn't reported. right_*: where the right side spells it otherwise. Empty
    sides give only missing rows; other columns of the tables aren't read.
    """
    names = list(fields)
    a = _rows(left, key, version, fields)
    b = _rows(right, right_key if right_key is not None else key, right_version if right_version is not None else version, right_fields or fields)
    carry = _narrow(left, fields) and _narrow(right, right_fields or fields)
    sides = materialize(_checksums(a, names, json_fields, 0, carry).unionByName(_checksums(b, names, json_fields, 1, carry)), "checksums")
    near = descend(sides, depths(sides.count() // 2, leaf_rows))
    of = lambda k, c: F.max(F.when(F.col("side") == k, F.col(c))).alias(f"{c}{k}")  # noqa: E731 (one row a side and key)
    pair = near.groupBy("key").agg(*[of(k, c) for c in (["sum", "row"] if carry else ["sum"]) for k in _SIDES]).where("not sum0 <=> sum1")
    missing = F.when(F.col("sum1").isNull(), F.lit(missing_right)).when(F.col("sum0").isNull(), F.lit(missing_left)).cast("string")
    if carry:
        both = pair
    else:
        pair = materialize(pair, "keys")
        known = pair.where("sum0 is not null and sum1 is not null").select("key")
        again = [d.join(known, "key", "left_semi").groupBy("key").agg(F.max_by("row", "rank").alias(f"row{k}")) for k, d in zip(_SIDES, (a, b))]
        both = again[0].join(again[1], "key").withColumns({"sum0": F.lit(0), "sum1": F.lit(0)})
    checks = []
    for n in names:
        u, v = F.col("row0")[n], F.col("row1")[n]
        differs = ~u.eqNullSafe(v)
        if n in json_fields:
            unlike = u.isNotNull() & v.isNotNull() & (u != v)
            both = both.withColumn(f"__same_{n}", canonical_json(F.when(unlike, u)) == canonical_json(F.when(unlike, v)))
            differs = differs & ~F.coalesce(F.col(f"__same_{n}"), F.lit(False))
        checks.append(F.when(F.col("sum0").isNotNull() & F.col("sum1").isNotNull() & differs, F.lit(n)))
    told = lambda d, found: d.select("key", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("finding"))
    return told(both, [missing, *checks]) if carry else told(pair, [missing]).unionAll(told(both, checks))

"""Exact percentiles of large groups, by rank.

Equal values are counted first. Approximate percentiles cut each group's values into stretches of
about equal size; the stretches' counts tell which one holds a rank, and only that one's values
are counted through. No task sorts or holds a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.session import materialize

STRETCHES = 64

#: Rank (from 0) of percentile p among n values, by rule.
RULES = {
    "floor": lambda p, n: F.least(n - 1, F.floor(p * n)),
    "nearest": lambda p, n: F.greatest(F.lit(0), F.ceil(p * n) - 1),
    "lower": lambda p, n: F.floor(p * (n - 1)),
    "upper": lambda p, n: F.ceil(p * (n - 1)),
}


def at_ranks(df: DataFrame, by: Sequence[str], value: Column, ps: Sequence[float], rule: str, stretches: int = STRETCHES) -> DataFrame:
    """(by..., n, mean, largest, p, value): the value at each percentile's rank by `rule`. Nulls and NaN are no values; groups without values give no row."""
    return _at(df, by, value, ps, [rule], stretches).drop("rule")


def _at(df: DataFrame, by: Sequence[str], value: Column, ps: Sequence[float], rules: Sequence[str], stretches: int = STRETCHES) -> DataFrame:
    by = list(by)
    counted = df.select(*by, value.alias("v")).where("v is not null and not isnan(v)").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("c"))
    counted = materialize(counted, "counted")  # it is read twice
    asked = lambda n: F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(rule).alias("rule"), RULES[rule](F.lit(float(p)), n).cast("bigint").alias("r")) for p in ps for rule in rules])
    cut = [i / stretches for i in range(1, stretches)]
    # A row per group: how many values, their mean, the largest, and where the stretches end.
    n = F.sum("c")
    size = counted.groupBy(*by).agg(F.struct(n.alias("n"), (F.sum(F.col("v").cast("double") * F.col("c")) / n).alias("mean"), F.max("v").alias("largest")).alias("of"), F.percentile_approx("v", cut, 10000).alias("cuts"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    place = F.size(F.filter("cuts", lambda x: x <= F.col("v"))).alias("s")
    near = counted.alias("a").join(size.alias("b"), same("a", "b")) if by else counted.alias("a").crossJoin(F.broadcast(size))  # without keys that is one row
    d = near.select(*[F.col(f"a.{k}").alias(k) for k in by], "v", "c", "of", place)
    sums = d.groupBy(*by, "s").agg(F.sum("c").alias("t"), F.first("of").alias("of"))
    before = sums.withColumn("before", F.sum("t").over(Window.partitionBy(*by).orderBy("s")) - F.col("t"))  # a row per stretch
    # The stretches that hold a rank asked for, a row each, with what is asked of them.
    hits = F.filter(asked(F.col("of.n")), lambda q: (q["r"] >= F.col("before")) & (q["r"] < F.col("before") + F.col("t")))
    want = before.select(*by, "s", "of", "before", hits.alias("asked")).where("size(asked) > 0")
    inside = d.drop("of").alias("d").join(want.alias("w"), [*same("d", "w"), F.col("d.s") == F.col("w.s")]).select(*[F.col(f"d.{k}").alias(k) for k in by], "d.s", "v", "c", "w.of", "w.before", "w.asked")
    upto = inside.withColumn("upto", F.col("before") + F.sum("c").over(Window.partitionBy(*by, "s").orderBy("v")))
    out = upto.select(*by, "of.*", F.inline(F.filter("asked", lambda q: (q["r"] < F.col("upto")) & (q["r"] >= F.col("upto") - F.col("c")))), "v")
    return out.select(*by, "n", "mean", "largest", "p", "rule", F.col("v").alias("value"))


def interpolated(df: DataFrame, by: Sequence[str], value: Column, ps: Sequence[float]) -> DataFrame:
    """(by..., n, mean, largest, p, value): between the two values around rank p (n - 1), in proportion."""
    both = _at(df, by, value, ps, ["lower", "upper"])
    of = lambda r: F.max(F.when(F.col("rule") == r, F.col("value")))
    pair = both.groupBy(*by, "n", "mean", "largest", "p").agg(of("lower").alias("lo"), of("upper").alias("hi"))
    at = F.col("p") * (F.col("n") - 1)
    return pair.select(*by, "n", "mean", "largest", "p", (F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at))).alias("value"))


def wide(df: DataFrame, by: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Percentiles as columns, beside n, mean and largest."""
    return df.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("n", "mean", "largest")], *[F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in names.items()])

import numpy as np
import pytest

from quaymark.llm.quantiles import EPSILON, LEVELS, _Stack, combine, compress, exact, merge, percentiles, permitted, quantile, rank_error, summarize


def off(a, q, p):
    r = min(max(int(np.ceil(p * len(a))), 1), len(a))
    lo, hi = np.searchsorted(a, q, "left") + 1, np.searchsorted(a, q, "right")
    return max(0, lo - r, r - hi)


def test_bounds_hold_through_merges():
    rng = np.random.default_rng(1)
    for _ in range(50):
        eps = float(rng.uniform(0.01, 0.2))
        raw = [rng.integers(0, 6, int(rng.integers(0, 300))).astype(float) if rng.random() < 0.5 else rng.normal(size=int(rng.integers(1, 300))) for _ in range(int(rng.integers(1, 12)))]
        parts, level = [compress(exact(v), permitted(eps, 1)) for v in raw], 1
        while len(parts) > 1:
            level += 1
            parts = [merge(parts[i : i + 3], permitted(eps, level)) for i in range(0, len(parts), 3)]
        s, a = parts[0], np.sort(np.concatenate(raw))
        assert s[3] == len(a) and rank_error(s) <= eps * len(a)
        if len(a):
            assert len(s[0]) <= 2 * LEVELS / eps
            assert (s[1] <= np.searchsorted(a, s[0], "right")).all() and (s[2] >= np.searchsorted(a, s[0], "left") + 1).all()
            assert all(off(a, quantile(s, p), p) <= rank_error(s) for p in np.linspace(0, 1, 41))
    assert quantile(exact(np.empty(0)), 0.5) is None and rank_error(exact(np.empty(0))) == 0


@pytest.mark.parametrize("eps", [0.02, 0.002])
def test_the_bound_holds_however_many_rows_a_task_has(eps):
    rng = np.random.default_rng(3)
    stack, every = _Stack(eps), []
    for _ in range(1100):  # three levels of WIDE
        every.append(rng.lognormal(size=1000))
        stack.add(compress(exact(every[-1]), permitted(eps, 1)))
    assert len(stack.levels) == 3
    s, a = stack.all(), np.sort(np.concatenate(every))
    assert rank_error(s) <= eps * len(a) and len(s[0]) < 2 * LEVELS / eps
    assert all(off(a, quantile(s, p), p) <= rank_error(s) for p in (0.001, 0.5, 0.9, 0.99, 0.999))


def test_epsilon_is_checked(spark):
    for eps in (0, 1, -0.1):
        with pytest.raises(ValueError, match="epsilon"):
            summarize(spark.createDataFrame([(1.0,)], "v double"), [], "v", eps)


def test_groups_over_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", i % 3, float(v)) for i, v in enumerate(rng.lognormal(size=30000))] + [("few", 0, 1.0), ("few", 1, 3.0), ("few", 1, None), ("none", 0, float("nan")), ("none", 0, float("inf")), (None, 0, 2.0)]
    d = spark.createDataFrame(rows, "g string, n int, v double").repartition(7)
    daily = summarize(d, ["g", "n"], "v", epsilon=0.01)
    out = {(r.g, r.p): r for r in percentiles(combine(daily, ["g"], epsilon=0.01, fan=2), ["g"], [0.5, 0.99]).collect()}
    assert {k[0] for k in out} == {"hot", "few", None}
    assert out["few", 0.5].value == 1.0 and out["few", 0.99].value == 3.0 and out["few", 0.5].rank_error == 0.0 and out[None, 0.5].value == 2.0
    a = np.sort([r[2] for r in rows if r[0] == "hot"])
    for p in (0.5, 0.99):
        r = out["hot", p]
        assert r.n == 30000 and 0 < r.rank_error <= 0.01 and off(a, r.value, p) <= r.rank_error * r.n + 1e-6
    empty = spark.createDataFrame([], "g string, n int, v double")
    assert percentiles(combine(summarize(empty, ["g"], "v"), ["g"]), ["g"], [0.5]).collect() == []


def test_query_within_its_stated_error(spark, tiny):
    import duckdb

    from quaymark.llm.latency import p5_percentiles, stage_gaps

    got = p5_percentiles(spark, tiny).collect()
    lat = {}
    for run, v in duckdb.sql(f"SELECT run_id, latency_p95 FROM (SELECT DISTINCT run_id, ts, t_sec, latency_p95 FROM '{tiny}/perf_samples.parquet') WHERE latency_p95 >= 0 AND NOT isnan(latency_p95) AND NOT isinf(latency_p95)").fetchall():
        lat.setdefault(run, []).append(v)
    gaps = {}
    for r in stage_gaps(spark, tiny).collect():
        gaps.setdefault((r.from_stage, r.to_stage), []).append(r.gap_ms)
    assert {r.run_id for r in got if r.run_id} == set(lat)
    for r in got:
        a = np.sort(lat[r.run_id] if r.run_id else gaps[r.from_stage, r.to_stage])
        assert r.n == len(a) and r.rank_error <= EPSILON and off(a, r.value, r.p) <= r.rank_error * r.n + 1e-6

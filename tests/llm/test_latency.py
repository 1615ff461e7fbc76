from collections import Counter

import duckdb
import numpy as np

from quaymark.llm.latency import p5_gaps_by_day, p5_percentiles, stage_gaps

ROWS = """
    ('t1', 'e', 'LOCK_GRANTED', 0), ('t2', 'e', 'FAILED', 10), ('t3', 'e', 'LOCK_GRANTED', 13), ('t3', 'e', 'LOCK_GRANTED', 13), ('t3', 'e', 'LOCK_GRANTED', 15),
    ('t4', 'e', 'TRANSITION', 20), (NULL, 'e', 'DONE', 25), (NULL, 'e', 'DONE', 25), (NULL, 'e', 'DONE', 27),
    ('u1', 'f', 'FAILED', 5), ('u2', 'f', 'DONE', 5), ('u3', 'g', 'DONE', 5), ('u4', NULL, 'DONE', 6), ('u5', 'f', NULL, 6), ('u6', 'f', 'DONE', NULL)
"""

VISITS = """
    WITH visit AS (SELECT event_id, min((epoch_us(ts), stage)) AS v FROM '{f}' WHERE event_id IS NOT NULL AND stage IS NOT NULL AND ts IS NOT NULL
                   GROUP BY event_id, trace_id, CASE WHEN trace_id IS NULL THEN (epoch_us(ts), stage) END),
    step AS (SELECT v, lead(v) OVER (PARTITION BY event_id ORDER BY v) AS x FROM visit)
    SELECT make_timestamp(v[1])::DATE AS day, v[2], x[2], (x[1] - v[1]) / 1000.0 FROM step WHERE x IS NOT NULL
"""


def test_second_visits_count(spark, tmp_path):
    duckdb.sql(f"COPY (SELECT trace_id, event_id, stage, make_timestamp(ms::BIGINT * 1000) AS ts FROM (VALUES {ROWS}) r(trace_id, event_id, stage, ms)) TO '{tmp_path}/event_trace.parquet'")
    got = sorted((r.from_stage, r.to_stage, r.gap_ms) for r in stage_gaps(spark, str(tmp_path)).collect())
    assert got == [("DONE", "DONE", 2.0), ("DONE", "FAILED", 0.0), ("FAILED", "LOCK_GRANTED", 3.0), ("LOCK_GRANTED", "FAILED", 10.0), ("LOCK_GRANTED", "TRANSITION", 7.0), ("TRANSITION", "DONE", 5.0)]


def test_gaps_against_sql(spark, tiny):
    want = duckdb.sql(VISITS.format(f=f"{tiny}/event_trace.parquet")).fetchall()
    got = Counter((r.day, r.from_stage, r.to_stage, round(r.gap_ms * 1000)) for r in stage_gaps(spark, tiny).collect())
    assert got == Counter((*r[:3], round(float(r[3]) * 1000)) for r in want)
    groups, days = {}, {}
    for day, a, b, ms in want:
        groups.setdefault((a, b), []).append(float(ms))
        days.setdefault((a, b, day), []).append(float(ms))
    assert ("FAILED", "LOCK_GRANTED") in groups
    for rows, by in ((p5_percentiles(spark, tiny).where("from_stage is not null").collect(), groups), (p5_gaps_by_day(spark, tiny).collect(), days)):
        key = (lambda r: (r.from_stage, r.to_stage, r.day)) if by is days else (lambda r: (r.from_stage, r.to_stage))
        assert {key(r) for r in rows} == set(by)
        for r in rows:
            a = np.sort(by[key(r)])
            rank = max(int(np.ceil(r.p * len(a))), 1)
            lo, hi = np.searchsorted(a, r.value - 1e-9, "left") + 1, np.searchsorted(a, r.value + 1e-9, "right")
            assert r.n == len(a) and max(0, lo - rank, rank - hi) <= r.rank_error * r.n + 1e-6

"""Buckets of tokens, block by block, against one walk over all calls of a key."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from recordloom.operators import throttling

T0 = datetime(2024, 1, 1)
CALLS = "api_key string, called_at timestamp_ntz"


def fold(times, rate, burst, seconds):
    """{instant: (calls, throttled)} by one walk in microseconds."""
    cost, full = seconds * 1_000_000, burst * seconds * 1_000_000
    tokens, last, out = full, None, {}
    for t in sorted(times):
        tokens = min(full, tokens + (t - last) * rate) if last is not None else full
        calls, throttled = out.get(t, (0, 0))
        served = tokens >= cost
        tokens, last = tokens - cost * served, t
        out[t] = (calls + 1, throttled + (not served))
    return {t: v for t, v in out.items() if v[1]}


def found(spark, times, **options):
    rows = [(key, T0 + timedelta(microseconds=t)) for key, all_ in times.items() for t in all_]
    df = spark.createDataFrame(rows, CALLS)
    out = {}
    for r in throttling.burst_breaches(df, **options).collect():
        micros = (r.called_at - T0) // timedelta(microseconds=1)
        out.setdefault(r.api_key, {})[micros] = (r.calls, r.throttled)
    return out


def test_block_functions_are_the_fold_from_any_start():
    rng = random.Random(3)
    for _ in range(200):
        cost = rng.choice([1, 7, 10])
        full = cost * rng.randrange(1, 5)
        pieces, steps = [(0, 1, 0)], []
        for _ in range(rng.randrange(1, 12)):
            step = (rng.randrange(0, full + 2), rng.randrange(1, 4))
            steps.append(step)
            pieces = throttling.after_calls(pieces, *step, cost, full)
        assert len(pieces) <= (full // cost + 1) * (len(steps) + 2)
        assert [p[0] for p in pieces] == sorted({p[0] for p in pieces}) and pieces[0][0] == 0
        for start in range(full + 1):
            tokens = start
            for gain, calls in steps:
                tokens = min(full, tokens + gain)
                for _ in range(calls):
                    tokens -= cost if tokens >= cost else 0
            _, slope, added = [p for p in pieces if p[0] <= start][-1]
            assert slope * start + added == tokens


def test_random_calls_match_the_fold(spark):
    rng = random.Random(8)
    for rate, burst, seconds, block in [(10, 2, 1, 1), (3, 5, 2, 1), (1, 1, 1, 3600)]:
        gap = seconds * 1_000_000 // rate
        times = {}
        for key in range(8):
            t, all_ = rng.randrange(10**6), []
            for _ in range(rng.randrange(1, 150)):
                t += rng.choice([0, 1, gap // 2, gap - 1, gap, gap + 1, 3 * gap, rng.randrange(2 * gap)])
                all_.append(t)
            times[f"k{key}"] = all_
        wanted = {k: w for k, t in times.items() if (w := fold(t, rate, burst, seconds))}
        assert found(spark, times, rate=rate, burst=burst, seconds=seconds, block_seconds=block) == wanted
        assert wanted


def test_a_hot_key_is_walked_in_many_blocks(spark):
    rng = random.Random(1)
    hot = [rng.randrange(60 * 10**6) for _ in range(3000)]
    times = {"hot": hot, "calm": [i * 10**6 for i in range(50)]}
    assert found(spark, times, block_seconds=1) == {"hot": fold(hot, 10, 2, 1)}


def test_empty_and_missing_values(spark):
    df = spark.createDataFrame([(None, T0), ("a", None), ("a", T0)], CALLS)
    assert throttling.burst_breaches(df).count() == 0
    assert throttling.burst_breaches(df.limit(0)).collect() == []
    same = spark.createDataFrame([("a", T0)] * 5, CALLS)
    assert [tuple(r) for r in throttling.burst_breaches(same).collect()] == [("a", T0, 5, 3)]

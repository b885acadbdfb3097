"""Trailing features against plain Python: prices of any magnitude, NaN and null, ties and block edges."""

import datetime as dt
import math
import random
from fractions import Fraction

import pytest

from tidemark.operators import features

UTC = dt.timezone.utc


def brute(rows, seconds):
    """Exact means, deviations and totals of each row's window; NaN where the window has one."""
    out = {}
    for i, ticker, ts, _, _ in rows:
        own = [(p, s) for _, k, t, p, s in rows if k == ticker and ts - dt.timedelta(seconds=seconds) <= t <= ts and t.isocalendar()[:2] == ts.isocalendar()[:2]]
        prices = [p for p, _ in own if p is not None]
        total = float(sum(Fraction(s) for _, s in own if s is not None))
        if any(math.isnan(p) for p in prices):
            out[i] = (math.nan, math.nan, total)
            continue
        mean = sum(map(Fraction, prices)) / len(prices) if prices else None
        var = sum((Fraction(p) - mean) ** 2 for p in prices) / len(prices) if prices else 0
        out[i] = (None if mean is None else float(mean), math.sqrt(var), total)
    return out


@pytest.mark.parametrize("scale", [1e-12, 1.0, 2e9, 1e12, 1e150])
def test_windows_equal_exact_sums(spark, scale):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 7, 23, 50, tzinfo=UTC)  # ten minutes before an ISO week ends
    rows = []
    for i in range(300):
        ts = start + dt.timedelta(seconds=rng.choice([rng.randrange(2400), 60 * rng.randrange(40)]), microseconds=rng.choice([0, 0, 1, 999_999]))
        price = rng.choice([None, scale * rng.random(), scale * (1 + rng.random() / 1000), scale]) if i % 97 else math.nan
        rows.append((i, rng.choice("AB"), ts, price, rng.choice([None, 1.0, 2.5])))
    df = spark.createDataFrame(rows, "event_id long, ticker string, ts timestamp, price double, size double").repartition(5)
    got = {r["event_id"]: r for r in features.trailing_features(df).collect()}
    assert len(got) == 300
    for name, seconds in features.WINDOWS.items():
        for i, (mean, std, total) in brute(rows, seconds).items():
            r = got[i]
            assert r[f"size_tot_{name}"] == pytest.approx(total)
            if mean is None:
                assert r[f"price_mean_{name}"] is None and r[f"price_std_{name}"] == 0.0
            else:
                assert r[f"price_mean_{name}"] == pytest.approx(mean, rel=1e-12, abs=0, nan_ok=True)
                assert r[f"price_std_{name}"] == pytest.approx(std, rel=1e-6, abs=1e-12 * scale, nan_ok=True)


def test_large_and_tiny_prices_do_not_touch_each_other(spark):
    start = dt.datetime(2024, 1, 3, 12, tzinfo=UTC)
    rows = [(i, "A", start + dt.timedelta(minutes=10 * i), p, 1.0) for i, p in enumerate([1e300, 1e-300, math.nan, 3e-300, 1e300, 5.0])]
    df = spark.createDataFrame(rows, "event_id long, ticker string, ts timestamp, price double, size double")
    got = {r["event_id"]: (r["price_mean_1min"], r["price_std_1min"]) for r in features.trailing_features(df, {"1min": 60}).collect()}
    assert {i: m for i, (m, _) in got.items() if i != 2} == {0: 1e300, 1: 1e-300, 3: 3e-300, 4: 1e300, 5: 5.0} and math.isnan(got[2][0])
    assert all(s == 0.0 for i, (_, s) in got.items() if i != 2)

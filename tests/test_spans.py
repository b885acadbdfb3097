"""One hot ticker in many tasks: sequences, labels, numbers, running maxima and general sentiment against plain Python."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features, spans, training

START = dt.datetime(2024, 1, 2, 23, 0, tzinfo=dt.timezone.utc)
SCHEMA = "event_id long, ticker string, ts timestamp, price double, size double"


@pytest.fixture(scope="module")
def hot(spark):
    """One ticker over ten days, days without a row among them, and one of a few rows."""
    rng = random.Random(11)
    seconds = sorted(rng.sample([s for s in range(0, 864_000, 5) if s // 86_400 not in (3, 4)], 700))
    rows = [(i, "HOT", START + dt.timedelta(seconds=s), float(rng.randrange(100)), 1.0) for i, s in enumerate(seconds)]
    rows += [(1000 + i, "few", START + dt.timedelta(hours=20 * i), float(i), 1.0) for i in range(3)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def many(spark, df):
    """Rows of df, made without adaptive merging of tasks, and how many tasks the hot ticker had."""
    held = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = df.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", held)
    return got, len({r["task"] for r in got if r["ticker"] == "HOT"})


def by_ticker(rows):
    return {k: sorted((r for r in rows if r[1] == k), key=lambda r: r[2]) for k in ("HOT", "few")}


def test_training_sequences_of_a_hot_ticker(spark, hot):
    rows, df = hot
    got, tasks = many(spark, training.training_sequences(df, ["price"], "price", "ts", 4))
    want = {own[i][0]: ([[r[3]] for r in own[i - 3 : i + 1]], own[i + 1][3]) for own in by_ticker(rows).values() for i in range(3, len(own) - 1)}
    assert {r["event_id"]: (r["sequence"], r["label"]) for r in got} == want and len(got) == len(want) and tasks > 3


def test_offset_sequences_of_a_hot_ticker(spark, hot):
    rows, df = hot
    got, tasks = many(spark, features.offset_sequences(df, ["price"], 3, 10))
    want = {}
    for own in by_ticker(rows).values():
        slots = {}
        for r in own:
            slots.setdefault(r[2].second // 10, []).append(r)
            last = slots[r[2].second // 10][-3:]
            if len(last) == 3:
                want[r[0]] = [[x[3]] for x in last]
    assert {r["event_id"]: r["sequence"] for r in got} == want and len(got) == len(want) and tasks > 3


def test_numbers_and_maxima_of_a_hot_ticker(spark, hot):
    rows, df = hot
    got, tasks = many(spark, spans.numbered(df, ["ticker"], ["ts"], spans.by_day()))
    assert {r["event_id"]: r["n"] for r in got} == {r[0]: i + 1 for own in by_ticker(rows).values() for i, r in enumerate(own)} and tasks > 3
    arrived = df.withColumn("arrival", F.col("event_id") * 7919 % 1009)
    got, tasks = many(spark, features.monotonic(arrived, "arrival", 50))
    want = set()
    for own in by_ticker(rows).values():
        top = None
        for r in sorted(own, key=lambda r: r[0] * 7919 % 1009):
            if top is None or r[2] > top:
                want.add(r[0])
                top = r[2]
    assert {r["event_id"] for r in got} == want and got[0].__fields__[:-1] == arrived.columns
    none = spark.createDataFrame([(1, None, None, 1.0, 1.0), (2, None, None, 1.0, 1.0)], SCHEMA)
    assert sorted(r["n"] for r in spans.numbered(none, ["ticker"], ["event_id"], spans.by_day()).collect()) == [1, 2]


@pytest.mark.parametrize("bad", [False, True])
def test_general_sentiment_by_cells(spark, hot, bad):
    rng = random.Random(2)
    points = hot[1].select("event_id", "ticker", "ts")
    points = points.unionByName(points.filter("event_id < 3").withColumn("ts", F.col("ts") + F.expr("INTERVAL 0.000001 SECOND")))
    made = [(rng.choice(["GENERAL", "GENERAL", "HOT"]), START + dt.timedelta(seconds=rng.randrange(-9000, 860_000), microseconds=rng.choice([0, 1, 999_999])), rng.choice(["bluesky", "news"]), rng.choice([None, rng.uniform(-1, 1)])) for _ in range(400)]
    at = [r[2] for r in hot[0]]
    made += [("GENERAL", at[50] - dt.timedelta(seconds=s), "bluesky", 0.75) for s in (0, 7200, 86_400, 7201)] + [("GENERAL", None, "bluesky", 1.0)]
    if bad:
        made.append(("GENERAL", at[200], "bluesky", math.nan))
    scores = spark.createDataFrame(made, "ticker string, ts timestamp, social string, sentiment_score double")
    horizons = {"short": ("bluesky", 7200), "day": ("bluesky", 86_400), "news": ("news", 20)}
    got = features.sentiment_features(scores, points, horizons, general=True).collect()
    assert len(got) == 706
    for r in got:
        t = r["ts"].replace(tzinfo=dt.timezone.utc)
        for name, (social, seconds) in horizons.items():
            own = [x for k, u, s, x in made if k == "GENERAL" and s == social and x is not None and u is not None and t - dt.timedelta(seconds=seconds) <= u <= t]
            assert r[name] == pytest.approx(sum(own) / len(own) if own else 0.0, abs=1e-12, nan_ok=True)
    plan = features.sentiment_features(scores, points, horizons, general=True)._jdf.queryExecution().executedPlan().toString()
    assert "event_id" not in "".join(x for x in plan.splitlines() if "Window [" in x)


@pytest.mark.parametrize("bucket", [86_400, 1800])
def test_grid_of_a_hot_ticker(spark, hot, bucket):
    """Quiet days, windows that reach back over buckets, cells without a price, and a null ticker against plain Python."""
    step, windows = 600, {"short": 1200, "long": 18_000}
    rows = hot[0] + [(2000, None, START, 5.0, 2.0), (2001, None, START + dt.timedelta(days=2), None, 3.0), (2002, None, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got, tasks = many(spark, features.grid_features(df, step, windows, ("ticker",), bucket))
    want = {}
    for who in ("HOT", "few", None):
        own = [(int(r[2].timestamp()), r[3], r[4]) for r in rows if r[1] == who and r[2]]
        last = dict.fromkeys(windows)
        for cell in range(min(t for t, *_ in own) // step + 1, max(t for t, *_ in own) // step + 2):
            out = []
            for name, seconds in windows.items():
                held = [r for r in own if cell * step - seconds <= r[0] < cell * step]
                prices = [p for _, p, _ in held if p is not None]
                last[name] = sum(prices) / len(prices) if prices else last[name]
                out += [last[name], sum(v for *_, v in held)]
            want[who, cell * step] = out
    assert len(got) == len(want) and tasks > 3
    for r in got:
        made = [r[c] for n in windows for c in (f"price_mean_{n}", f"size_tot_{n}")]
        assert made == pytest.approx(want[r["ticker"], int(r["ts"].replace(tzinfo=dt.timezone.utc).timestamp())], abs=1e-9)


def test_context_is_carried_from_day_to_day(spark, hot):
    from tidemark.operators import joins

    rows, df = hot
    rng = random.Random(4)
    made = [(START + dt.timedelta(seconds=rng.randrange(-90_000, 700_000)), rng.choice([None, float(i)]), float(i)) for i in range(60)]
    context = spark.createDataFrame(made, "ts timestamp, cpi double, ffr double")
    got = joins.latest_context_join(df, context, 600, ["cpi", "ffr"]).collect()
    cells = {}
    for ts, cpi, ffr in sorted(made):
        cells[int(ts.timestamp()) // 600] = (cpi, ffr)
    assert len(got) == len(rows)
    for r in got:
        before = [cells[c] for c in sorted(cells) if c < int(r["ts"].replace(tzinfo=dt.timezone.utc).timestamp()) // 600]
        assert [r["cpi"], r["ffr"]] == [next((x[k] for x in reversed(before) if x[k] is not None), None) for k in (0, 1)]

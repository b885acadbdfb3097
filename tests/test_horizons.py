"""Streamed horizon means: every instant, late rows, empty horizons, bounded state, restarts."""

import datetime as dt
import random

from tidemark.streaming import horizons

SCHEMA = "ticker string, ts timestamp, social string, sentiment_score double"
START = dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc)
HORIZONS = {"short": ("bluesky", 60), "long": ("bluesky", 3600), "news": ("news", 1800)}
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def put(spark, path, rows):
    made = [(k, START + dt.timedelta(seconds=s), social, x) for k, s, social, x in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, every):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    scores = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    df = horizons.horizon_features(scores, HORIZONS, 10, every, "1 minute")
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    first = int(START.timestamp())
    return {(r["ticker"], r["at"] - first): tuple(round(r[k], 6) for k in HORIZONS) for r in spark.read.schema(df.schema).parquet(f"{path}/out").collect()}


def brute(rows, upto, every):
    out = {}
    for ticker in {r[0] for r in rows}:
        own = [(s // 10 * 10 + 10, social, x) for k, s, social, x in rows if k == ticker and x is not None]
        ends = [e for e, social, _ in own if social in ("bluesky", "news")]
        at = range(min(ends), upto + 1, 10) if every else sorted({e + d for e, social, _ in own for name, (s, n) in HORIZONS.items() if s == social for d in (0, n)})
        for t in at:
            if t <= upto:
                held = [[x for e, social, x in own if social == s and t - n < e <= t] for s, n in HORIZONS.values()]
                out[ticker, t] = tuple(round(sum(h) / len(h), 6) if h else 0.0 for h in held)
    return out


def test_every_instant_over_two_runs(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("AB"), rng.randrange(900), rng.choice(["bluesky", "news", "other"]), rng.choice([None, rng.random(), -rng.random()])) for _ in range(80)]
    put(spark, f"{tmp_path}/in", rows[:40])
    run(spark, tmp_path, True)  # a run that ends, and one that takes up its state
    later = [(k, s + 900, social, x) for k, s, social, x in rows[40:]]
    put(spark, f"{tmp_path}/in", later + [("A", 5000, "news", 0.5), ("A", -5000, "bluesky", 9.0), ("B", 5000, "other", 1.0)])
    got = run(spark, tmp_path, True)
    want = brute(rows[:40] + later, 4940, True)  # the newest row less the delay; the late row is not in
    wrong = sorted((k, got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k))
    assert not wrong[:5], len(wrong)
    assert any(v[0] == v[2] == 0.0 for v in got.values())


def test_changes_only_and_bounded_state(spark, tmp_path):
    rows = [("A", 7 * i, ("bluesky", "news")[i % 2], float(i % 5)) for i in range(300)]
    for k in range(3):
        put(spark, f"{tmp_path}/in", rows[k::3] if k == 0 else [(t, s + 10_000 * k, x, y) for t, s, x, y in rows[k::3]])
    put(spark, f"{tmp_path}/in", [("A", 40_000, "news", 1.0)])
    got = run(spark, tmp_path, False)
    every = rows[0::3] + [(t, s + 10_000 * k, x, y) for k in (1, 2) for t, s, x, y in rows[k::3]]
    assert got == brute(every, 39_940, False)
    # All cells but the last row's have left every horizon, and with them the state.
    state = spark.read.format("statestore").option("stateVarName", "cells").option("flattenCollectionTypes", True).load(f"{tmp_path}/log")
    assert state.count() == 1


def test_cells_are_held_in_blocks(spark, tmp_path):
    rows = [("A", 7 * i, ("bluesky", "news")[i % 2], float(i % 5)) for i in range(2000)]
    for k in range(2):
        put(spark, f"{tmp_path}/in", rows[1000 * k : 1000 * k + 1000])
        got = run(spark, tmp_path, False)
        state = spark.read.format("statestore").option("stateVarName", "cells").option("flattenCollectionTypes", True).load(f"{tmp_path}/log")
        assert 1 < state.count() < 10
    put(spark, f"{tmp_path}/in", [("A", 14_010, "news", None), ("A", 5, "news", 99.0), ("A", 14_060, "other", 1.0)])
    got = run(spark, tmp_path, False)
    assert got == brute(rows, 14_000, False)

"""Records at one time, and parts of a batch in any order."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.streaming import jobs

START = dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streamed(spark, path, rows, schema, made):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    df = made(spark.readStream.schema(schema).parquet(f"{path}/in"))
    df.writeStream.outputMode("update").foreachBatch(lambda out, b: out.write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out").collect()


def test_a_grid_begins_at_the_earliest_row_of_all_parts(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [("A", START + dt.timedelta(seconds=10 * i), None if i == 33 else float(i)) for i in reversed(range(100))]
        got = streamed(spark, tmp_path, rows, "ticker string, ts timestamp, price double", lambda t: jobs.grid_means(t, 10, "1 minute"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first = int(START.timestamp())
    assert sorted(((r["at"] - first) // 10, r["mean"]) for r in got) == [(i + 1, float(i if i != 33 else 32)) for i in range(93)]


def test_the_last_arrival_of_a_time_is_the_observation(spark, tmp_path):
    schema, t = "event_id long, series string, ts timestamp, value double", lambda s: START + dt.timedelta(seconds=s)
    rows = [(2, "cpi", t(0), 5.0), (1, "cpi", t(0), 4.0), (3, "cpi", t(1), 4.0), (4, "cpi", t(1), 5.0), (5, "cpi", t(2), 6.0), (6, "cpi", t(2), None)]
    got = streamed(spark, tmp_path, rows, schema, jobs.macro_changes)
    assert sorted((r["ts"].replace(tzinfo=dt.timezone.utc), r["value"]) for r in got) == [(t(0), 5.0), (t(2), 6.0)]
    got = streamed(spark, tmp_path, [(7, "cpi", t(3), 6.0), (8, "cpi", t(4), 7.0)], schema, jobs.macro_changes)
    assert sorted(r["value"] for r in got) == [5.0, 6.0, 7.0]


def test_records_of_one_time_are_all_stored(spark, tmp_path):
    rows = [(i, "A", START, float(i), i) for i in range(4)] + [(2, "A", START, -1.0, -1)]
    df = spark.createDataFrame(rows, "event_id long, ticker string, ts timestamp, price double, arrival long")
    for name in ("trades", "predictions"):
        sinks.write_store(df, name, f"{tmp_path}/{name}", F.col("arrival"))
        assert sorted(r["price"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect()) == [0.0, 1.0, 2.0, 3.0]


def test_sentiment_of_a_dense_ticker_without_sliding_windows(spark):
    from tidemark.operators import features

    rows = [(i, "AB"[i % 3 == 0], START + dt.timedelta(seconds=7 * (i // 2)), ("bluesky", "news")[i % 5 == 0], None if i % 11 == 0 else i / 8) for i in range(300)]
    scores = spark.createDataFrame(rows, "id long, ticker string, ts timestamp, social string, sentiment_score double")
    horizons = {"short": ("bluesky", 20), "long": ("news", 300)}
    out = features.sentiment_features(scores, scores.select("id", "ticker", "ts"), horizons)
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {r["id"]: (r["short"], r["long"]) for r in out.collect()}
    for i, ticker, ts, _, _ in rows:
        own = [[x for _, k, t, s, x in rows if k == ticker and s == social and x is not None and ts - dt.timedelta(seconds=n) <= t <= ts] for social, n in horizons.values()]
        assert got[i] == tuple(sum(o) / len(o) if o else 0.0 for o in own)


def test_a_json_record_is_parsed_once(spark, small):
    from tidemark.plans import registry

    plan = registry.queries()["json_scalars"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("to_json") + plan.count("StructsToJsonEvaluator") <= 6


def test_rows_of_one_arrival_come_by_event_id(spark, tmp_path):
    from tidemark.plans import registry

    # Arrivals repeat after 1000003 events: of ids 5 and 1000008 the first came first, whatever the order of the file.
    for turn in (1, -1):
        rows = [(5 + 1_000_003 * k, START.replace(tzinfo=None) + dt.timedelta(seconds=k), k, "view", 1.0, "") for k in range(4)][::turn]
        events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
        events.coalesce(1).write.parquet(f"{tmp_path}/{turn}/events.parquet")
        got = registry.queries()["monotonic_points"](spark, f"{tmp_path}/{turn}").collect()
        assert sorted(r["event_id"] for r in got) == [5, 1000008, 2000011, 3000014]

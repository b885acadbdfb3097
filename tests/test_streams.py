"""Streams that are cut off and started again, late rows, buffers, sinks and scorers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, records, text
from tidemark.sources import readers, sinks
from tidemark.streaming import jobs

SCHEMA = "event_id long, ticker string, ts timestamp, price double, size double"
START = dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc)


def put(spark, path, rows):
    """A file of trades: (id, seconds after the start, price)."""
    made = [(i, "A", START + dt.timedelta(seconds=s), float(p), 1.0) for i, s, p in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, path):
    df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return [r.asDict() for r in df.sparkSession.read.schema(df.schema).parquet(f"{path}/out").collect()]


def each(df, write, path):
    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()


def test_a_stream_resumes_from_its_checkpoint(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 1), (2, 10, 2)])
    first = run(jobs.distinct_records(stream(spark, f"{tmp_path}/in"), ["event_id"]), tmp_path)
    assert sorted(r["event_id"] for r in first) == [1, 2]
    put(spark, f"{tmp_path}/in", [(2, 20, 9), (3, 30, 3)])
    again = run(jobs.distinct_records(stream(spark, f"{tmp_path}/in"), ["event_id"]), tmp_path)
    assert sorted((r["event_id"], r["price"]) for r in again) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert len(run(jobs.distinct_records(stream(spark, f"{tmp_path}/in"), ["event_id"]), tmp_path)) == 3


def test_late_rows_go_and_windows_wait_for_the_watermark(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 10), (2, 700, 20)])
    assert run(jobs.partial_sums(stream(spark, f"{tmp_path}/in"), "1 minute", "5 minutes"), tmp_path)[0]["x"] == 10.0
    put(spark, f"{tmp_path}/in", [(3, 5, 99), (4, 690, 1), (5, 2000, 5)])
    out = {int((r["at"].replace(tzinfo=dt.timezone.utc) - START).total_seconds()): r["x"] for r in run(jobs.partial_sums(stream(spark, f"{tmp_path}/in"), "1 minute", "5 minutes"), tmp_path)}
    assert out == {0: 10.0, 660: 21.0}


def test_buffered_batches_are_replayed_once_ready(spark, tmp_path):
    got, state = [], {"ready": False}

    def sink(df, batch_id):
        got.append(sorted((r["_batch"], r["event_id"]) for r in df.collect()))

    def write():
        return jobs.buffered(spark, f"{tmp_path}/buffer", lambda: state["ready"], sink)

    for k in range(2):
        put(spark, f"{tmp_path}/in", [(k, k, k)])
        each(stream(spark, f"{tmp_path}/in"), write(), tmp_path)
    assert got == []
    state["ready"] = True
    put(spark, f"{tmp_path}/in", [(2, 2, 2)])
    each(stream(spark, f"{tmp_path}/in"), write(), tmp_path)
    assert got == [[(0, 0), (1, 1), (2, 2)]]
    put(spark, f"{tmp_path}/in", [(3, 3, 3)])
    each(stream(spark, f"{tmp_path}/in"), write(), tmp_path)
    assert got[1:] == [[(3, 3)]] and not jobs.flush_buffer(spark, f"{tmp_path}/buffer", stream(spark, f"{tmp_path}/in").schema, lambda: True, sink)


def test_a_buffer_of_a_stream_that_ends_early_is_flushed(spark, tmp_path):
    got = []
    put(spark, f"{tmp_path}/in", [(1, 0, 1)])
    each(stream(spark, f"{tmp_path}/in"), jobs.buffered(spark, f"{tmp_path}/buffer", lambda: False, lambda df, b: got.append(df.count())), tmp_path)
    schema = stream(spark, f"{tmp_path}/in").schema
    assert not jobs.flush_buffer(spark, f"{tmp_path}/buffer", schema, lambda: False, lambda df, b: got.append(df.count()))
    assert jobs.flush_buffer(spark, f"{tmp_path}/buffer", schema, lambda: True, lambda df, b: got.append(df.count()))
    assert got == [1]


def test_topics_of_a_batch_and_the_console(spark, tmp_path, capfd):
    put(spark, f"{tmp_path}/in", [(1, 0, 1)])
    df = spark.read.parquet(f"{tmp_path}/in")
    assert sinks.write_records(df.select("event_id", "price"), {"format": "text", "path": f"{tmp_path}/topic"}) is None
    back = readers.read_records(spark, {"format": "text", "path": f"{tmp_path}/topic"}, "event_id long, price double")
    assert [tuple(r) for r in back.collect()] == [(1, 1.0)]
    writer = sinks.write_records(stream(spark, f"{tmp_path}/in"), {"format": "console"})
    writer.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    sinks.write_records(df, {"format": "console"})


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v"), F.lit(1).alias("at"))
    sinks.upsert(rows, path, ["k"], "at")
    before = sinks._newest(spark, path)
    for at in (2, 2, 3):
        sinks.upsert(spark.createDataFrame([(5, at * 10, at), (200, at, at)], "k long, v int, at int"), path, ["k"], "at")
    after = sinks._newest(spark, path)
    assert sum(after[b] != before.get(b) for b in after) <= 2
    got = {r["k"]: r["v"] for r in sinks.upserted(spark, path).collect()}
    assert len(got) == 101 and got[5] == 30 and got[200] == 3 and got[6] == 0
    sinks.upsert(rows.limit(0), path, ["k"], "at")
    assert sinks.upserted(spark, path).count() == 101


def test_tables_are_made_once(spark):
    for _ in range(2):
        sinks.create_table(spark, "tidemark_made_once", "a int")
    assert spark.table("tidemark_made_once").columns == ["a"]
    spark.sql("DROP TABLE tidemark_made_once")


def test_broken_records_become_errors(spark):
    row = spark.range(1).select(*records.error_record(F.lit("{"), F.lit(0).cast("timestamp"))).first()
    assert (row["ticker"], row["sentiment_score"], row["raw"]) == (["ERROR"], 0.0, "{")


def test_interval_labels(spark, tmp_path):
    put(spark, f"{tmp_path}/in", [(1, 0, 10), (2, 30, 20), (3, 90, 30), (4, 1000, 40)])
    t = spark.read.parquet(f"{tmp_path}/in")
    got = {}
    for r in joins.interval_label(t.select("event_id", "ticker", "ts"), t).collect():
        got.setdefault(r["event_id"], []).append(r["_price"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [10.0, 20.0], 2: [10.0, 20.0, 30.0], 3: [10.0, 20.0, 30.0], 4: [40.0]}


def test_a_model_scores_in_batches(spark):
    def logits(parts):
        import numpy as np
        import pandas as pd

        for part in parts:
            yield pd.Series([np.array([float("up" in t), 0.0, float("down" in t)]) for t in part.fillna("")])

    rows = spark.createDataFrame([("up",), ("down",), ("flat",), (" ",), (None,)], "text string")
    got = [r["sentiment_score"] for r in text.score_text(rows, "text", text.model_scorer(logits)).collect()]
    assert got[0] == -got[1] == pytest.approx(0.0282, abs=1e-3) and got[2:] == [0.0, 0.0, 0.0]


def test_keywords_with_and_without_inner_words(spark):
    texts = spark.createDataFrame([(1, "the big Red fox ran"), (2, "bigred"), (3, "ab"), (4, None), (5, "xx foxes xx fox")], "id long, text string")
    keywords = spark.createDataFrame([("k1", "big red f"), ("k2", "fox"), ("k3", "ab"), ("k4", "g red fo"), ("k5", "longer than any text"), ("k6", "bigred")], "name string, keyword string")
    got = sorted((r["id"], r["name"]) for r in text.keyword_match(texts, keywords).collect())
    assert got == [(1, "k1"), (1, "k2"), (1, "k4"), (2, "k6"), (3, "k3"), (5, "k2")]


def test_a_reader_sees_an_upsert_whole_or_not_at_all(spark, tmp_path):
    path, schema = f"file://{tmp_path}/s", "k long, v int, at int"
    with pytest.raises(FileNotFoundError):
        sinks.upserted(spark, path)
    sinks.upsert(spark.range(100).selectExpr("id as k", "0 as v", "0 as at"), path, ["k"], "at")

    def seen():
        return {r["k"]: r["v"] for r in sinks.upserted(spark, path).collect()}

    new = spark.range(50, 150).selectExpr("id as k", "1 as v", "1 as at")
    staged = sinks.stage_upsert(new, path, ["k"], "at", buckets=7)  # another number of buckets does not move a key
    assert seen() == dict.fromkeys(range(100), 0)
    open_ = sinks.upserted(spark, path)
    sinks.publish_upsert(spark, path, *staged)
    assert seen() == dict.fromkeys(range(50), 0) | dict.fromkeys(range(50, 150), 1)
    assert open_.count() == 100  # a reader of the version before
    with pytest.raises(RuntimeError, match="another writer"):
        sinks.publish_upsert(spark, path, *staged)
    for v in range(2, 6):
        sinks.upsert(spark.createDataFrame([(7, v, v)], schema), path, ["k"], "at", buckets=3 + v)
    assert seen()[7] == 5 and len(seen()) == 150
    assert len(list((tmp_path / "s" / "versions").glob("v*.json"))) == 2
    sinks.upsert(spark.createDataFrame([], schema), f"{path}2", ["k"], "at")
    assert sinks.upserted(spark, f"{path}2").collect() == []


@pytest.mark.parametrize("kind", ["text", "json"])
def test_latest_starts_after_what_is_there(spark, tmp_path, kind):
    """Files of before the first start never come; those written while the stream is down do, once."""
    (tmp_path / "in").mkdir()

    def put(n):
        time.sleep(0.05)
        (tmp_path / f"in/{n}.json").write_text(f'{{"n": {n}}}\n')

    def run():
        time.sleep(0.05)
        rows = readers.read_records(spark, {"format": kind, "path": f"{tmp_path}/in"}, "n long", streaming=True, start="latest", mark=f"{tmp_path}/mark")
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r[0] for r in spark.read.schema("n long").parquet(f"{tmp_path}/out").collect())

    put(1)
    assert run() == []
    put(2)
    put(3)
    assert run() == [2, 3]
    put(4)
    assert run() == [2, 3, 4] and run() == [2, 3, 4]
    with pytest.raises(ValueError):
        readers.read_records(spark, {"format": kind, "path": f"{tmp_path}/in"}, "n long", streaming=True, start="latest")
    with pytest.raises(ValueError):
        readers.read_records(spark, {"format": kind, "path": f"{tmp_path}/in"}, "n long", start="latest", mark=f"{tmp_path}/mark")

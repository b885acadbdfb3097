"""Rows that wait for their dimensions, restarts between release and commit, and the global context record."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import context, waiting

START = dt.datetime(2024, 1, 2, 15, 0, 0, 123456, tzinfo=dt.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS, MACRO, FUNDS = "event_id long, ticker string, ts timestamp, price double", "series string, value double", "symbol string"


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def trades(*ids, ticker="A"):
    return [(i, ticker, START + dt.timedelta(seconds=i), None if i % 5 == 0 else i / 3) for i in ids]


class Gate:
    def __init__(self, spark, path, required=("cpi", "ffr")):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        self.spark, self.path, self.fail = spark, path, False
        for name, schema in (("rows", ROWS), ("macro", MACRO), ("funds", FUNDS)):
            put(spark, f"{path}/{name}", [], schema)
        self.required = required

    def run(self):
        streams = [self.spark.readStream.schema(s).parquet(f"{self.path}/{n}") for n, s in (("rows", ROWS), ("macro", MACRO), ("funds", FUNDS))]
        tickers = self.spark.createDataFrame([("A",), ("B",), ("A",)], "ticker string")

        def write(df, batch):
            df.write.mode("overwrite").parquet(f"{self.path}/out/batch={batch}")
            if self.fail and df.count():
                raise RuntimeError("lost between release and commit")

        out = waiting.until_ready(*streams, tickers, self.required)
        out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{self.path}/log").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["event_id"], r["waited"]) for r in self.spark.read.parquet(f"{self.path}/out").collect())


def test_rows_wait_for_all_dimensions(spark, tmp_path):
    gate = Gate(spark, str(tmp_path))
    put(spark, gate.path + "/rows", trades(1, 2, 3) + trades(4, ticker="B") + trades(99, ticker="unknown"), ROWS)
    assert gate.run() == []
    put(spark, gate.path + "/macro", [("cpi", 1.0), ("other", 2.0)], MACRO)
    put(spark, gate.path + "/funds", [("Z",)], FUNDS)
    put(spark, gate.path + "/rows", trades(5), ROWS)
    assert gate.run() == []
    # All are there: the release is written, but the batch fails before it commits, and is run again.
    put(spark, gate.path + "/macro", [("ffr", None)], MACRO)
    put(spark, gate.path + "/rows", trades(6), ROWS)
    gate.fail = True
    with pytest.raises(Exception, match="lost between"):
        gate.run()
    gate.fail = False
    assert gate.run() == [(1, True), (2, True), (3, True), (4, True), (5, True), (6, False)]
    put(spark, gate.path + "/rows", trades(7, 8) + trades(9, ticker="B"), ROWS)
    assert gate.run()[6:] == [(7, False), (8, False), (9, False)]
    back = {r["event_id"]: (r["ticker"], r["ts"].replace(tzinfo=dt.timezone.utc), r["price"]) for r in spark.read.parquet(gate.path + "/out").collect()}
    assert all(back[i] == (t, ts, p) for i, t, ts, p in trades(1, 2, 3, 5, 6, 7, 8) + trades(4, 9, ticker="B"))


def test_context_is_sent_on_posts_and_changes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    one, two = "id long, ts timestamp, series string, value double", "id long, ts timestamp, sentiment_score double"
    t = lambda s: START + dt.timedelta(seconds=s)

    def run():
        macro, posts = spark.readStream.schema(one).parquet(f"{tmp_path}/m"), spark.readStream.schema(two).parquet(f"{tmp_path}/p")
        df = context.global_context(macro, posts, {"short": 100, "long": 1000}, ("cpi", "ffr"))
        df.writeStream.outputMode("update").foreachBatch(lambda rows, b: rows.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={b}")).option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["us"] // 1_000_000 - int(START.timestamp()), r["kind"], r["id"], r["cpi"], r["ffr"], r["short"], r["long"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put(spark, f"{tmp_path}/m", [(1, t(0), "cpi", 3.0), (2, t(10), "cpi", 3.0), (3, t(20), "ffr", 5.0), (4, t(20), "gdp", 1.0), (5, None, "cpi", 9.0), (6, t(30), "cpi", None)], one)
    put(spark, f"{tmp_path}/p", [(1, t(20), 0.5), (2, t(15), 1.5), (3, t(16), None)], two)
    first = [(0, 0, 1, 3.0, None, 0.0, 0.0), (15, 1, 2, 3.0, None, 1.5, 1.5), (20, 0, 3, 3.0, 5.0, 1.5, 1.5), (20, 1, 1, 3.0, 5.0, 1.0, 1.0)]
    assert run() == first
    put(spark, f"{tmp_path}/m", [(7, t(40), "cpi", 3.0), (8, t(50), "cpi", 4.0)], one)
    put(spark, f"{tmp_path}/p", [(9, t(120), 0.5), (10, t(5000), -1.0)], two)
    assert run() == first + [(50, 0, 8, 4.0, 5.0, 1.0, 1.0), (120, 1, 9, 4.0, 5.0, 0.5, pytest.approx(2.5 / 3)), (5000, 1, 10, 4.0, 5.0, -1.0, -1.0)]
    state = spark.read.format("statestore").option("stateVarName", "posts").option("flattenCollectionTypes", True).load(f"{tmp_path}/log")
    assert state.count() == 1


def test_a_hot_ticker_waits_in_many_slots(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        gate = Gate(spark, str(tmp_path))
        put(spark, gate.path + "/rows", trades(*range(400)) + trades(400, ticker=None), ROWS)
        assert gate.run() == []
        held = spark.read.format("statestore").option("stateVarName", "held").load(f"{tmp_path}/log").select("key.*").distinct().collect()
        assert sum(r["ticker"] == "A" for r in held) > 8
        put(spark, gate.path + "/macro", [(x, 1.0) for x in ("cpi", "ffr") * 20], MACRO)
        put(spark, gate.path + "/funds", [("Z",)] * 30, FUNDS)
        assert gate.run() == [(i, True) for i in range(400)]
        put(spark, gate.path + "/rows", trades(*range(500, 600)), ROWS)
        assert gate.run()[400:] == [(i, False) for i in range(500, 600)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    back = {r["event_id"]: (r["ts"].replace(tzinfo=dt.timezone.utc), r["price"]) for r in spark.read.parquet(gate.path + "/out").collect()}
    assert all(back[i] == (ts, p) for i, _, ts, p in trades(*range(400)))

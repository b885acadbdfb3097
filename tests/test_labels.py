"""Streamed labels of a hot ticker: by buckets of time, over two runs, with ties and rows without a trade."""

import datetime as dt
import random

from tidemark.streaming import jobs, labels

SCHEMA = "event_id long, ticker string, ts timestamp, price double"
START = dt.datetime(2024, 1, 2, 15, tzinfo=dt.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_labels_of_a_hot_ticker(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rng = random.Random(3)
    rows = [(i, rng.choice(["A", "A", "A", "B", None]), rng.randrange(90_000), rng.choice([None, *range(9)])) for i in range(400)]
    rows += [(1000 + i, "A", 5 * (i % 90), float(i)) for i in range(300)]  # several at one time

    def run(some):
        made = [(i, k, START + dt.timedelta(seconds=s), None if p is None else float(p)) for i, k, s, p in some]
        spark.createDataFrame(made, SCHEMA).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        a, b = (spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in") for _ in range(2))
        df = jobs.labelled(a.select("event_id", "ticker", "ts"), b, delay="1 minute")
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        got = spark.read.schema(df.schema).parquet(f"{tmp_path}/out").collect()
        assert all(r["ts"].replace(tzinfo=dt.timezone.utc) == START + dt.timedelta(seconds={x[0]: x[2] for x in rows}[r["event_id"]]) for r in got)
        return sorted(((r["event_id"], r["ticker"], r["y1"]) for r in got), key=lambda r: r[0])

    def want(upto):
        out = []
        for i, k, s, _ in sorted(rows):
            if s + 60 <= upto:
                near = [(t, -j, p) for j, m, t, p in rows if m == k and k is not None and p is not None and s - 240 <= t <= s + 60]
                out.append((i, k, float(max(near)[2]) if near else None))
        return out

    early, late = [r for r in rows if r[2] < 40_000], [r for r in rows if r[2] >= 40_000]
    assert run(early) == want(max(r[2] for r in early) - 60)
    assert run(late) == want(max(r[2] for r in rows) - 60)
    state = spark.read.format("statestore").option("stateVarName", "chunks").option("flattenCollectionTypes", True).load(f"{tmp_path}/log")
    assert state.count() <= 4 and labels.SPAN < 90_000 / 3

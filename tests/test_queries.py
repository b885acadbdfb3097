"""Every registered query with SQL against DuckDB on the small tables; streams against their batch forms; the entry."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.plans import registry
from tidemark.streaming import jobs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_numeric_dtype(out[c]) or pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype(float)
        else:
            out[c] = out[c].map(lambda x: "" if x is None or x is pd.NA or x != x else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.sql()))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    got, want = plain(registry.queries()[name](spark, small).toPandas()), plain(con.execute(registry.sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        if got[c].dtype == float:
            assert np.array_equal(got[c], want[c], equal_nan=True), c
        else:
            assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.sql())))
def test_query_without_sql_has_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("files", [1, 2, 7])
def test_stream_equals_batch_however_the_input_is_cut(spark, small, tmp_path, files):
    events = spark.read.parquet(f"{small}/events.parquet")
    bounds = [events.agg(F.max("event_id")).first()[0] * k // files for k in range(files + 1)]
    for k in range(files):
        part = events.filter((F.col("event_id") > bounds[k]) if k else F.lit(True)).filter(F.col("event_id") <= bounds[k + 1])
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    from tidemark.plans import fixtures as fx
    from tidemark.plans.streams import _run

    stream = fx.trades_of(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    got = {(r["ticker"], r["at"]): (r["n"], round(r["x"], 6)) for r in _run(jobs.partial_sums(stream, "10 minutes", "40 days")).collect()}
    batch = fx.trades_of(events).groupBy(F.window("ts", "10 minutes").alias("w"), "ticker").agg(F.count("*").alias("n"), F.sum("price").alias("x"))
    want = {(r["ticker"], r["w"]["start"]): (r["n"], round(r["x"], 6)) for r in batch.collect()}
    assert set(got.items()) <= set(want.items())
    got = {r["event_id"] for r in _run(jobs.distinct_records(stream, ["event_id"], "40 days").select("event_id")).collect()}
    assert got == {r["event_id"] for r in events.collect()}


def test_shuffled_input_gives_the_same(spark, small):
    from tidemark.operators import features
    from tidemark.plans import fixtures as fx

    t = fx.trades(spark, small)
    a = features.price_spikes(t, 20.0, "2 hours").orderBy("ticker", "window_start").collect()
    assert a == features.price_spikes(t.repartition(7, F.rand(1)), 20.0, "2 hours").orderBy("ticker", "window_start").collect()

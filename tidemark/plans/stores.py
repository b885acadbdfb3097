"""Queries that write a store and read it back: what comes back must be what the source view holds, once for each key."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import records
from ..sources import readers, sinks
from . import fixtures as fx
from .registry import query


def _root(spark) -> str:
    """A new folder in the folder that all executors share, spark.checkpoint.dir; a session of one process, as in tests, makes its own."""
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-stores-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top}/stores-{uuid.uuid4().hex}"


def _back(spark, df, name, order):
    path = _root(spark)
    sinks.write_store(df, name, path, order)
    return spark.read.option("basePath", path).parquet(path)


@query("store_trades", f"WITH {fx.TRADES} SELECT ticker, strftime(ts, '%Y-%m-%d') AS date, epoch_us(ts) AS us, price, size FROM trades")
def trades(spark, d):
    t = fx.trades(spark, d)
    t = t.withColumn("arrival", F.lit(1))
    out = _back(spark, t.unionByName(t.filter("event_id % 5 = 0").withColumn("price", F.lit(-1.0)).withColumn("arrival", F.lit(0))), "trades", F.col("arrival"))
    return out.select("ticker", F.col("date").cast("string").alias("date"), micros("ts").alias("us"), "price", "size")


@query("store_news", f"WITH {fx.POSTS} SELECT id, source AS ticker, strftime(ts, '%Y-%m-%d') AS date, length(text) AS n FROM posts")
def news(spark, d):
    p = fx.posts(spark, d).withColumnRenamed("source", "ticker")
    return _back(spark, p, "news", F.col("ts")).select("id", "ticker", F.col("date").cast("string").alias("date"), F.length("text").cast("long").alias("n"))


@query("store_posts", f"WITH {fx.POSTS} SELECT id, strftime(ts, '%Y-%m-%d') AS date, source AS keyword, CASE WHEN id % 9 = 0 THEN 0 ELSE length(text) END AS n FROM posts")
def posts(spark, d):
    p = fx.posts(spark, d).withColumnRenamed("source", "keyword").withColumn("text", F.coalesce(F.when(F.col("id") % 9 != 0, F.col("text")), F.lit("")))
    return _back(spark, p, "posts", F.col("ts")).select("id", F.col("date").cast("string").alias("date"), "keyword", F.length("text").cast("long").alias("n"))


@query("store_forum", f"WITH {fx.POSTS} SELECT id, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN id % 4 = 0 THEN 'unknown' ELSE source END AS subreddit FROM posts")
def forum(spark, d):
    p = fx.posts(spark, d).select("id", "ts", F.when(F.col("id") % 4 != 0, F.col("source")).alias("subreddit"))
    return _back(spark, p, "forum", F.col("ts")).select("id", F.col("date").cast("string").alias("date"), "subreddit")


@query("store_macro", f"WITH {fx.RAW_MACRO}, {fx.MACRO} SELECT series, CAST(year(date) AS INT) AS year, CAST(date AS VARCHAR) AS date, value FROM macro")
def macro(spark, d):
    m = records.clean_macro(fx.raw_macro(spark, d), 1996)
    return _back(spark, m, "macro", F.col("value")).select("series", F.col("year").cast("int").alias("year"), F.col("date").cast("string").alias("date"), "value")


@query("store_sentiment", f"WITH {fx.POSTS} SELECT social, ticker, strftime(ts, '%y-%m') AS month, max(id) AS id FROM (SELECT *, (['CLICK', 'ERROR', 'PURCHASE', 'SIGNUP', 'VIEW', 'GENERAL'])[id % 6 + 1] AS ticker FROM posts) GROUP BY social, ticker, ts")
def sentiment(spark, d):
    s = records.explode_tickers(fx.with_tickers(fx.posts(spark, d))).select("id", "ts", "social", "ticker")
    return _back(spark, s, "sentiment", F.col("id")).select("social", "ticker", F.col("month").cast("string").alias("month"), "id")


@query("store_predictions", f"WITH {fx.TRADES} SELECT ticker, strftime(ts, '%y-%m') AS month, event_id, price AS prediction FROM trades WHERE NOT simulated AND price != 0")
def predictions(spark, d):
    p = fx.trades(spark, d).select("event_id", "ticker", "ts", F.col("price").alias("prediction"), F.col("simulated").alias("is_simulated_prediction"))
    return _back(spark, records.real_only(p), "predictions", F.col("event_id")).select("ticker", F.col("month").cast("string").alias("month"), "event_id", "prediction")


@query("store_bars", f"WITH {fx.TRADES}, {fx.BARS} SELECT symbol AS ticker, CAST(isoyear(ts) AS INT) AS year, CAST(week(ts) AS INT) AS week, epoch_us(ts) AS us, close FROM bars")
def bars(spark, d):
    b = fx.bars(spark, d).withColumnRenamed("symbol", "ticker")
    return _back(spark, b, "bars", F.col("close")).select("ticker", F.col("year").cast("int").alias("year"), F.col("week").cast("int").alias("week"), micros("ts").alias("us"), "close")


@query("store_fundamentals", f'WITH {fx.FUNDAMENTALS} SELECT symbol, CAST("calendarYear" AS INT) AS "calendarYear", round(eps, 6) AS eps FROM fundamentals WHERE loaded = 2')
def fundamentals(spark, d):
    f = fx.fundamentals(spark, d)
    return _back(spark, f, "fundamentals", F.col("loaded")).select("symbol", F.col("calendarYear").cast("int").alias("calendarYear"), F.round("eps", 6).alias("eps"))


@query("store_upsert", f"WITH {fx.TRADES} SELECT ticker, epoch_us(date_trunc('hour', ts)) AS hour_us, max(event_id) AS event_id, arg_max(price, event_id) AS price FROM trades GROUP BY 1, 2")
def upsert(spark, d):
    """Two writes, the second twice; keys that both have keep the newest."""
    t = fx.trades(spark, d).select("ticker", micros(F.date_trunc("HOUR", "ts")).alias("hour_us"), "event_id", "price")
    newest = records.dedupe(t, ["ticker", "hour_us"], F.col("event_id"), last=True)
    path = _root(spark)
    sinks.upsert(t, path, ["ticker", "hour_us"], "event_id")
    for _ in range(2):
        sinks.upsert(newest.filter("event_id % 2 = 0"), path, ["ticker", "hour_us"], "event_id")
    return sinks.upserted(spark, path)


@query("fundamentals_read", f'WITH {fx.FUNDAMENTALS} SELECT symbol, round(eps, 6) AS eps FROM fundamentals WHERE loaded = 2 AND "calendarYear" = \'1997\'')
def fundamentals_read(spark, d):
    """The store of fundamentals, read for one year."""
    f = fx.fundamentals(spark, d)
    path = _root(spark)
    sinks.write_store(f, "fundamentals", path, F.col("loaded"))
    return readers.read_fundamentals(spark, path, 1997).select("symbol", F.round("eps", 6).alias("eps"))


@query("ticker_read", f"WITH {fx.TRADES} SELECT event_id, epoch_us(ts) AS us, price FROM trades WHERE ticker = 'CLICK'")
def ticker_read(spark, d):
    return readers.read_ticker(fx.trades(spark, d), "CLICK", "ts").select("event_id", micros("ts").alias("us"), "price")


@query("macro_intervals", f"WITH {fx.RAW_MACRO}, {fx.MACRO} SELECT series, CAST(date AS VARCHAR) AS date, CAST(lead(date) OVER (PARTITION BY series ORDER BY date) AS VARCHAR) AS until, value FROM macro")
def macro_intervals(spark, d):
    from ..operators import joins

    out = joins.valid_until(records.clean_macro(fx.raw_macro(spark, d), 1996), "series", "date")
    return out.select("series", F.col("date").cast("string").alias("date"), F.col("until").cast("string").alias("until"), "value")


@query("by_ticker_partitions", f"WITH {fx.TRADES} SELECT ticker, count(*) AS n, CAST(1 AS BIGINT) AS n_partitions FROM trades GROUP BY 1")
def by_ticker(spark, d):
    """Rows dealt by ticker: each ticker is in one partition."""
    dealt = records.partition_by_ticker(fx.trades(spark, d), 2).withColumn("p", F.spark_partition_id())
    return dealt.groupBy("ticker").agg(F.count("*").alias("n"), F.count_distinct("p").alias("n_partitions"))

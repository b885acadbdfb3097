"""Streaming twins: the tables replayed as file streams, to completion, and what the sink holds then."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import text
from ..sources import readers, sinks
from ..streaming import context, horizons, jobs, waiting
from . import fixtures as fx
from .macro import _CONTEXT as CONTEXT
from .macro import _context as context_of
from .market import _SPIKES
from .registry import query
from .stores import _root
from .texts import _SCORED, _TICKER

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(spark, d, name):
    """A table as a stream of its Parquet files: a folder of them, or one file beside other tables'."""
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _run(df, mode="append"):
    """All that the stream gives, as a table in the shared folder."""
    spark = df.sparkSession
    root = _root(spark)
    out = df.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def _each(df, write):
    """All micro-batches of the stream through `write`."""
    df.writeStream.foreachBatch(write).option("checkpointLocation", f"{_root(df.sparkSession)}/log").trigger(availableNow=True).start().awaitTermination()


@query("stream_distinct", "SELECT DISTINCT event_id FROM events")
def distinct(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(jobs.distinct_records(events, ["event_id"], "60 days").select("event_id"))


#: What the watermark has closed at the end: windows that end 10 minutes before the newest row, or earlier.
_CLOSED = "(SELECT epoch_ms(max(ts)) - 600000 FROM trades)"


@query("stream_sliding", f"""WITH {fx.TRADES}, w AS (SELECT *, unnest([1, 2, 3]) AS k FROM trades), e AS (SELECT *, CAST((floor(epoch_us(ts) / 600000000) + k) * 600000 AS BIGINT) AS ms FROM w)
SELECT ticker, ms * 1000 AS at_us, round(avg(price) + 1e-9, 4) AS price_mean, sum(size) AS size_tot, count(*) AS n FROM e WHERE ms <= {_CLOSED} GROUP BY ticker, ms""")
def sliding(spark, d):
    trades = fx.trades_of(_stream(spark, d, "events"))
    return _run(jobs.sliding_features(trades, "30 minutes", "10 minutes")).select("ticker", micros("at").alias("at_us"), F.round(F.col("price_mean") + 1e-9, 4).alias("price_mean"), "size_tot", "n")


@query("stream_partials", f"""WITH {fx.TRADES}, e AS (SELECT *, CAST(floor(epoch_us(ts) / 600000000) * 600000 AS BIGINT) AS ms FROM trades)
SELECT ticker, ms * 1000 AS at_us, count(price) AS n, round(sum(price), 4) AS x, round(sum(price * price), 4) AS xx, sum(size) AS v FROM e WHERE ms + 600000 <= {_CLOSED} GROUP BY ticker, ms""")
def partials(spark, d):
    return _run(jobs.partial_sums(fx.trades_of(_stream(spark, d, "events")), "10 minutes")).select("ticker", micros("at").alias("at_us"), "n", F.round("x", 4).alias("x"), F.round("xx", 4).alias("xx"), "v")


@query("stream_spikes", f"WITH {fx.TRADES}, {_SPIKES} SELECT ticker, CAST(start AS BIGINT) AS window_start, lo AS min_price, hi AS max_price, round(price_difference, 6) AS price_difference FROM spikes WHERE (start + 7200) * 1000 <= {_CLOSED}")
def spikes(spark, d):
    out = _run(jobs.spikes(fx.trades_of(_stream(spark, d, "events")), 20.0, "2 hours"))
    return out.select("ticker", F.unix_seconds("window_start").alias("window_start"), "min_price", "max_price", F.round("price_difference", 6).alias("price_difference"))


# A row is told once the trades up to its horizon, a minute on, are closed.
@query("stream_labels", f"""WITH {fx.TRADES} SELECT f.event_id, arg_max(t.price, (t.ts, -t.event_id)) AS y1 FROM trades f JOIN trades t ON f.ticker = t.ticker AND t.ts <= f.ts + INTERVAL 60 SECOND AND t.ts >= f.ts - INTERVAL 240 SECOND
WHERE epoch_ms(f.ts) + 60000 <= {_CLOSED} GROUP BY f.event_id""")
def labels(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    a, b = (fx.trades_of(_stream(spark, d, "events")) for _ in range(2))
    return _run(jobs.labelled(a.select("event_id", "ticker", "ts"), b)).select("event_id", "y1")


# Simulated trades with the price of a real one, which few have; a row without one is told as the watermark passes.
@query("stream_labels_of_all", f"""WITH {fx.TRADES} SELECT f.event_id, arg_max(t.price, (t.ts, -t.event_id)) AS y1 FROM trades f LEFT JOIN trades t ON f.ticker = t.ticker AND NOT t.simulated AND t.ts <= f.ts + INTERVAL 60 SECOND AND t.ts >= f.ts - INTERVAL 240 SECOND
WHERE f.simulated AND epoch_ms(f.ts) + 60000 < (SELECT least(max(epoch_ms(ts)) FILTER (WHERE simulated), max(epoch_ms(ts)) FILTER (WHERE NOT simulated)) - 600000 FROM trades) GROUP BY f.event_id""")
def labels_of_all(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    a, b = (fx.trades_of(_stream(spark, d, "events")) for _ in range(2))
    return _run(jobs.labelled(a.filter("simulated").select("event_id", "ticker", "ts"), b.filter("not simulated"))).select("event_id", "y1")


@query("stream_first_in_minute", f"WITH {fx.TRADES} SELECT DISTINCT ticker, epoch_us(date_trunc('minute', ts)) AS minute_us FROM trades")
def first_minute(spark, d):
    return _run(jobs.first_in_minute(fx.trades_of(_stream(spark, d, "events"))).select("ticker", micros("minute").alias("minute_us")))


@query("stream_grid", f"""WITH {fx.TRADES}, c AS (SELECT ticker, CAST(floor(epoch_us(ts) / 600000000) AS BIGINT) AS cell, avg(price) AS m FROM trades GROUP BY 1, 2), span AS (SELECT ticker, min(cell) AS lo FROM c GROUP BY 1),
g AS (SELECT ticker, unnest(generate_series(lo + 1, CAST(floor({_CLOSED} / 600000) AS BIGINT))) AS cell FROM span)
SELECT g.ticker, g.cell * 600 AS at, round(last_value(c.m IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-9, 4) AS mean FROM g LEFT JOIN c ON c.ticker = g.ticker AND c.cell = g.cell - 1""")
def grid(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return _run(jobs.grid_means(fx.trades_of(_stream(spark, d, "events")), 600)).select("ticker", "at", F.round(F.col("mean") + 1e-9, 4).alias("mean"))


@query("stream_session_switch", f"""WITH {fx.TRADES}, w AS (SELECT *, unnest([1, 2, 3]) AS k FROM trades), e AS (SELECT *, CAST((floor(epoch_us(ts) / 600000000) + k) * 600000 AS BIGINT) AS ms FROM w),
s AS (SELECT ticker, simulated, ms, round(avg(price) + 1e-9, 4) AS price_mean, count(*) AS n, make_timestamp(ms * 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS l FROM e WHERE ms <= {_CLOSED} GROUP BY ticker, simulated, ms),
o AS (SELECT *, NOT (hour(l) * 60 + minute(l) >= 570 AND hour(l) < 16 AND isodow(l) < 6) AS outside FROM s) SELECT ticker, ms * 1000 AS at_us, price_mean, n, outside AS simulated FROM o WHERE simulated = outside""")
def session_switch(spark, d):
    out = _run(jobs.session_switched(fx.trades_of(_stream(spark, d, "events")), "30 minutes", "10 minutes"))
    return out.select("ticker", micros("at").alias("at_us"), F.round(F.col("price_mean") + 1e-9, 4).alias("price_mean"), "n", F.col("is_simulated_prediction").alias("simulated"))


@query("stream_context", f"WITH {fx.TRADES}, {CONTEXT} SELECT t.event_id, t.price, coalesce(c.cpi, 0) AS cpi, coalesce(c.ffr, 0) AS ffr FROM trades t ASOF JOIN context c ON t.ts >= c.ts")
def stream_context(spark, d):
    """Each micro-batch with the newest context at its rows' times, into a store."""
    path = f"{_root(spark)}/rows"
    trades = fx.trades_of(_stream(spark, d, "events")).select("event_id", "ticker", "ts", "price")
    _each(trades, jobs.with_context(trades, lambda: context_of(spark, d), ["cpi", "ffr"], lambda df: df.write.mode("append").parquet(path)))
    return spark.read.parquet(path).select("event_id", "price", "cpi", "ffr")


@query("stream_routed", f"WITH {fx.TRADES} SELECT event_id, simulated AS routed FROM trades")
def routed(spark, d):
    """Rows to one of two sinks by a predicate."""
    root = _root(spark)
    sinks_ = {k: (F.col("simulated") == (k == "simulated"), lambda df, k=k: df.write.mode("append").parquet(f"{root}/{k}")) for k in ("real", "simulated")}
    trades = fx.trades_of(_stream(spark, d, "events")).select("event_id", "simulated")
    _each(trades, jobs.routed(sinks_))
    return spark.read.parquet(f"{root}/real", f"{root}/simulated").select("event_id", F.col("simulated").alias("routed"))


@query("stream_buffered", f"WITH {fx.TRADES} SELECT event_id, price FROM trades")
def buffered(spark, d):
    """Rows held back while the dimensions are not there, which they are when the stream ends, and replayed then."""
    root = _root(spark)
    trades = fx.trades_of(_stream(spark, d, "events")).select("event_id", "price")
    seen = []

    def sink(df, batch_id):
        df.select("event_id", "price").write.mode("append").parquet(f"{root}/rows")

    def ready():
        seen.append(1)
        return len(seen) > 1

    _each(trades, jobs.buffered(spark, f"{root}/buffer", ready, sink))
    jobs.flush_buffer(spark, f"{root}/buffer", trades.schema, ready, sink)
    return spark.read.parquet(f"{root}/rows")


@query("stream_macro_changes", f"""WITH m AS (SELECT CASE user_id % 3 WHEN 0 THEN 'cpi' WHEN 1 THEN 'ffr' ELSE 't2y' END AS series, ts, event_id, round(value / 100) AS value FROM events),
n AS (SELECT series, ts, arg_max(value, event_id) AS value FROM m GROUP BY 1, 2), c AS (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS before FROM n) SELECT series, epoch_us(ts) AS us, value FROM c WHERE before IS NULL OR before != value""")
def macro_changes(spark, d):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    e = _stream(spark, d, "events")
    series = F.element_at(F.array(F.lit("cpi"), F.lit("ffr"), F.lit("t2y")), (F.col("user_id") % 3 + 1).cast("int"))
    rows = e.select("event_id", series.alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") / 100).alias("value"))
    return _run(jobs.macro_changes(rows)).select("series", micros("ts").alias("us"), "value")


@query("stream_topic", f"WITH {fx.TRADES} SELECT event_id, ticker, price FROM trades")
def topic(spark, d):
    """Trades written as JSON records to a topic and read back from it, both as streams."""
    root = _root(spark)
    trades = fx.trades_of(_stream(spark, d, "events")).select("event_id", "ticker", "price")
    writer = sinks.write_records(trades, {"format": "text", "path": f"{root}/topic"}, "ticker")
    writer.option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return _run(readers.read_records(spark, {"format": "text", "path": f"{root}/topic"}, "event_id long, ticker string, price double", streaming=True))


_SCORES = f"{fx.POSTS}, {_SCORED}, p AS (SELECT *, {_TICKER} AS ticker FROM scored)"
_TOLD = "(SELECT epoch_ms(max(ts)) - 600000 FROM p)"


def _scores(spark, d):
    """Posts as they stream by, with their score and ticker."""
    posts = fx.with_tickers(text.score_text(fx.posts_of(_stream(spark, d, "documents")), "text"))
    return posts.select("ts", "social", F.col("ticker")[0].alias("ticker"), "sentiment_score")


@query("stream_sentiment", f"""WITH {_SCORES}, w AS (SELECT *, unnest(generate_series(1, 12)) AS k FROM p),
e AS (SELECT *, CAST((floor(epoch_us(ts) / 600000000) + k) * 600000 AS BIGINT) AS ms FROM w) SELECT ticker, social, ms * 1000 AS at_us, round(avg(score) + 1e-9, 5) AS mean, CAST(count(*) AS BIGINT) AS n FROM e WHERE ms <= {_TOLD} GROUP BY 1, 2, 3""")
def stream_sentiment(spark, d):
    return _run(jobs.horizon_means(_scores(spark, d), "2 hours", "10 minutes")).select("ticker", "social", micros("at").alias("at_us"), F.round(F.col("mean") + 1e-9, 5).alias("mean"), "n")


_HORIZONS = {"sentiment_bluesky_mean_2hours": ("bluesky", 7200), "sentiment_bluesky_mean_1day": ("bluesky", 86400), "sentiment_news_mean_1day": ("news", 86400), "sentiment_news_mean_3days": ("news", 259200)}


@query("stream_horizons", f"""WITH {_SCORES}, e AS (SELECT *, CAST(floor(epoch_us(ts) / 10000000) + 1 AS BIGINT) * 10 AS t FROM p),
i AS ({" UNION ".join(f"SELECT ticker, t + {d} AS t FROM e WHERE social = '{s}'" for s, n in _HORIZONS.values() for d in (0, n))})
SELECT i.ticker, i.t AS at, {", ".join(f"round(coalesce(avg(e.score) FILTER (WHERE e.social = '{s}' AND e.t > i.t - {n}), 0) + 1e-9, 5) AS {k}" for k, (s, n) in _HORIZONS.items())}
FROM i JOIN e ON e.ticker = i.ticker AND e.t <= i.t WHERE i.t * 1000 <= {_TOLD} GROUP BY i.ticker, i.t""")
def stream_horizons(spark, d):
    """All horizons at once on the 10-second grid, at the instants where one of them changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    out = _run(horizons.horizon_features(_scores(spark, d), _HORIZONS, 10, every=False))
    return out.select("ticker", "at", *[F.round(F.col(k) + 1e-9, 5).alias(k) for k in _HORIZONS])


_WAIT_CUT = "(SELECT (max(event_id) + 1) // 2 FROM events)"


@query("stream_until_ready", f"WITH {fx.TRADES} SELECT event_id, price, epoch_us(ts) AS us, event_id < {_WAIT_CUT} AS waited FROM trades")
def until_ready(spark, d):
    """The first half of the trades arrives, then macro values and fundamentals, then the rest: the first waits for the dimensions, none is lost or doubled."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    root = _root(spark)
    trades = fx.trades(spark, d).select("event_id", "ticker", "ts", "price")
    cut = (trades.agg(F.max("event_id")).first()[0] + 1) // 2
    macro, funds = fx.raw_macro(spark, d).select("series"), fx.fundamentals(spark, d).select("symbol")
    places = {"rows": trades, "macro": macro, "funds": funds}
    for name, df in places.items():
        df.limit(0).write.parquet(f"{root}/{name}")
    streams = [spark.readStream.schema(df.schema).parquet(f"{root}/{name}") for name, df in places.items()]
    tickers = fx.companies(spark, d).filter("is_active").select("ticker")
    required = tuple(r[0] for r in macro.distinct().orderBy("series").collect())
    arrivals = [("rows", trades.filter(F.col("event_id") < cut)), ("macro", macro), ("funds", funds), ("rows", trades.filter(F.col("event_id") >= cut))]
    for name, df in arrivals:
        df.write.mode("append").parquet(f"{root}/{name}")
        out = waiting.until_ready(*streams, tickers, required)
        out.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "price", micros("ts").alias("us"), "waited")


_ALIASES = ("cpi", "ffr", "t2y")
_GENERAL = {"sentiment_general_bluesky_mean_2hours": 7200, "sentiment_general_bluesky_mean_1day": 86400}


@query("stream_global_context", f"""WITH {_SCORES}, m AS (SELECT event_id AS id, ts, ['cpi', 'ffr', 't2y'][user_id % 3 + 1] AS series, round(value / 100) AS value FROM events),
c AS (SELECT * FROM m QUALIFY coalesce(lag(value) OVER (PARTITION BY series ORDER BY ts, id) != value, true)), g AS (SELECT * FROM p WHERE ticker = 'GENERAL'),
a AS (SELECT ts, 0 AS kind, id, {", ".join(f"CASE WHEN series = '{x}' THEN value END AS {x}" for x in _ALIASES)} FROM c UNION ALL SELECT ts, 1, id, NULL, NULL, NULL FROM g),
l AS (SELECT ts, kind, id, {", ".join(f"last_value({x} IGNORE NULLS) OVER w AS {x}" for x in _ALIASES)} FROM a WINDOW w AS (ORDER BY ts, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT epoch_us(l.ts) AS us, l.kind, l.id, any_value(cpi) AS cpi, any_value(ffr) AS ffr, any_value(t2y) AS t2y, {", ".join(f"round(coalesce(avg(q.score) FILTER (WHERE q.ts >= l.ts - INTERVAL {n} SECOND), 0) + 1e-9, 5) AS {k}" for k, n in _GENERAL.items())}
FROM l LEFT JOIN g q ON (q.ts < l.ts OR q.ts = l.ts AND l.kind = 1 AND q.id <= l.id) AND q.ts >= l.ts - INTERVAL 86400 SECOND GROUP BY l.ts, l.kind, l.id""")
def stream_global_context(spark, d):
    """A record with all aliases for each general post and each macro value that has changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    series = F.element_at(F.array(*[F.lit(x) for x in _ALIASES]), (F.col("user_id") % 3 + 1).cast("int"))
    macro = _stream(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), series.alias("series"), F.round(F.col("value") / 100).alias("value"))
    posts = fx.with_tickers(text.score_text(fx.posts_of(_stream(spark, d, "documents")), "text")).filter("ticker[0] = 'GENERAL'").select("id", "ts", "sentiment_score")
    out = _run(context.global_context(macro, posts, _GENERAL, _ALIASES))
    return out.select("us", "kind", "id", *_ALIASES, *[F.round(F.col(k) + 1e-9, 5).alias(k) for k in _GENERAL])

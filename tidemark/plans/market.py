"""Queries over trades and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import times
from ..operators import features, joins, serving, spans
from . import fixtures as fx
from .registry import query
from .registry import registered_sql as registry_sql

_WINDOWS = {"1min": 60, "5min": 300, "30min": 1800, "5h": 18000, "1day": 86400}


def _r(c, alias=None, n=6):
    return F.round(c, n).alias(alias or c)


def _half_up(c, n):
    """Means of prices often end in a 5, which the last bit would round either way; a nudge settles it in Spark and SQL alike."""
    return F.round(F.col(c) + 1e-9, n).alias(c)


def _trailing_sql() -> str:
    cols = []
    for name, s in _WINDOWS.items():
        over = f"OVER (PARTITION BY ticker, isoyear(ts), week(ts) ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND PRECEDING AND CURRENT ROW)"
        cols.append(f"round(avg(price) {over} + 1e-9, 6) AS price_mean_{name}, round(coalesce(stddev_pop(price) {over}, 0), 4) AS price_std_{name}, coalesce(sum(size) {over}, 0) AS size_tot_{name}")
    return f"WITH {fx.TRADES} SELECT event_id, ticker, {', '.join(cols)} FROM trades"


@query("trailing_features", _trailing_sql())
def trailing(spark, d):
    out = features.trailing_features(fx.trades(spark, d), _WINDOWS)
    return out.select("event_id", "ticker", *[x for n in _WINDOWS for x in (_half_up(f"price_mean_{n}", 6), _r(f"price_std_{n}", n=4), F.col(f"size_tot_{n}"))])


@query("grid_features_ffill", f"""WITH {fx.TRADES}, span AS (SELECT ticker, simulated, floor(epoch_us(min(ts)) / 600000000) AS lo, floor(epoch_us(max(ts)) / 600000000) AS hi FROM trades GROUP BY 1, 2),
grid AS (SELECT ticker, simulated, unnest(generate_series(CAST(lo + 1 AS BIGINT), CAST(hi + 1 AS BIGINT))) AS cell FROM span),
part AS (SELECT g.ticker, g.simulated, g.cell, avg(price) FILTER (WHERE epoch_us(ts) >= (g.cell * 600 - 1800) * 1000000) AS m30, coalesce(sum(size) FILTER (WHERE epoch_us(ts) >= (g.cell * 600 - 1800) * 1000000), 0) AS v30, avg(price) AS m5h, coalesce(sum(size), 0) AS v5h
 FROM grid g LEFT JOIN trades t ON t.ticker = g.ticker AND t.simulated = g.simulated AND epoch_us(ts) < g.cell * 600000000 AND epoch_us(ts) >= (g.cell * 600 - 18000) * 1000000 GROUP BY 1, 2, 3)
SELECT ticker, simulated, cell * 600 AS at, round(last_value(m30 IGNORE NULLS) OVER w + 1e-9, 4) AS price_mean_30min, round(last_value(m5h IGNORE NULLS) OVER w + 1e-9, 4) AS price_mean_5h, v30 AS size_tot_30min, v5h AS size_tot_5h FROM part
WINDOW w AS (PARTITION BY ticker, simulated ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def grid(spark, d):
    out = features.grid_features(fx.trades(spark, d), 600, {"30min": 1800, "5h": 18000})
    return out.select("ticker", "simulated", F.unix_seconds("ts").alias("at"), _half_up("price_mean_30min", 4), _half_up("price_mean_5h", 4), "size_tot_30min", "size_tot_5h")


_NY = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
_SOD = f"(hour({_NY}) * 3600 + minute({_NY}) * 60 + second({_NY}))"
_WD = f"(isodow({_NY}) - 1)"


@query("session_filter", f"WITH {fx.TRADES} SELECT event_id, {_SOD} >= 34200 AND {_SOD} < 57600 AND {_WD} < 5 AS regular, {_SOD} >= 34200 AND {_SOD} < 57540 AND {_WD} < 5 AS labelled FROM trades")
def session(spark, d):
    return fx.trades(spark, d).select("event_id", times.in_session("ts").alias("regular"), times.in_session("ts", end="15:59").alias("labelled"))


@query("bar_session_filter", f"WITH {fx.TRADES}, {fx.BARS} SELECT symbol, epoch_us(ts) AS us, open, close, volume FROM bars WHERE {_SOD} >= 34200 AND {_SOD} <= 57600")
def bar_session(spark, d):
    return fx.bars(spark, d).filter(times.in_session("ts", closed=True, weekdays=False)).select("symbol", times.micros("ts").alias("us"), "open", "close", "volume")


@query("calendar_features", f"""WITH {fx.TRADES}, s AS (SELECT event_id, {_NY} AS l, {_SOD} - 34200 AS late, epoch_us({_NY}) - epoch_us(date_trunc('day', {_NY})) - 34200000000 AS us FROM trades)
SELECT event_id, CAST(CASE WHEN us < 0 THEN -floor(-us / 60000000.0) ELSE floor(us / 60000000.0) END AS INT) AS minutes_since_open, CAST(isodow(l) - 1 AS INT) AS day_of_week, CAST(day(l) AS INT) AS day_of_month, CAST(week(l) AS INT) AS week_of_year, CAST(month(l) AS INT) AS month_of_year,
CAST(late >= 0 AND late < 300 AS INT) AS market_open_spike_flag, CAST(late >= 23100 AND late < 23400 AS INT) AS market_close_spike_flag FROM s""")
def calendar(spark, d):
    return fx.trades(spark, d).select("event_id", *times.calendar_features("ts", "stream"))


@query("calendar_features_batch", f"""WITH {fx.TRADES}, s AS (SELECT event_id, ts, epoch_us({_NY}) - epoch_us(date_trunc('day', {_NY})) - 34200000000 AS us FROM trades)
SELECT event_id, CAST(greatest(floor(us / 60000000.0), 0) AS INT) AS minutes_since_open, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(day(ts) AS INT) AS day_of_month, CAST(week(ts) AS INT) AS week_of_year, CAST(month(ts) AS INT) AS month_of_year,
CAST(us >= 0 AND us <= 240000000 AS INT) AS market_open_spike_flag, CAST(us >= 23160000000 AND us <= 23400000000 AS INT) AS market_close_spike_flag FROM s""")
def calendar_batch(spark, d):
    return fx.trades(spark, d).select("event_id", *times.calendar_features("ts", "batch"))


_SPIKES = f"""spikes AS (SELECT *, CASE WHEN hi_us < lo_us THEN lo - hi ELSE hi - lo END AS price_difference FROM (SELECT ticker, floor(epoch_us(ts) / 7200000000) * 7200 AS start, min(price) AS lo, max(price) AS hi,
 epoch_us(arg_min(ts, (price, epoch_us(ts)))) AS lo_us, epoch_us(arg_max(ts, (price, -epoch_us(ts)))) AS hi_us, count(*) AS n FROM trades GROUP BY 1, 2) WHERE n >= 2 AND hi - lo > 20)"""


def _spikes(spark, d):
    return features.price_spikes(fx.trades(spark, d), 20.0, "2 hours")


@query("price_spikes", f"WITH {fx.TRADES}, {_SPIKES} SELECT ticker, CAST(start AS BIGINT) AS window_start, lo AS min_price, hi AS max_price, lo_us AS min_us, hi_us AS max_us, round(price_difference, 6) AS price_difference FROM spikes")
def spikes(spark, d):
    return _spikes(spark, d).select("ticker", F.unix_seconds("window_start").alias("window_start"), "min_price", "max_price", times.micros("min_timestamp").alias("min_us"), times.micros("max_timestamp").alias("max_us"), _r("price_difference"))


@query("last_anomaly", f"""WITH {fx.TRADES}, {_SPIKES} SELECT ticker, round(arg_max(price_difference, (greatest(lo_us, hi_us), least(lo_us, hi_us))), 6) AS price_difference, max(greatest(lo_us, hi_us)) AS end_us,
arg_max(CASE WHEN price_difference >= 0 THEN 'up' ELSE 'down' END, (greatest(lo_us, hi_us), least(lo_us, hi_us))) AS direction FROM spikes GROUP BY 1""")
def last_anomaly(spark, d):
    return serving.last_anomaly(serving.anomaly_span(_spikes(spark, d))).select("ticker", _r("price_difference"), times.micros("end").alias("end_us"), "direction")


@query("minute_bars", f"WITH {fx.TRADES}, {fx.BARS} SELECT symbol, epoch_us(ts) AS us, open, close, volume FROM bars")
def minute_bars(spark, d):
    return fx.bars(spark, d).select("symbol", times.micros("ts").alias("us"), "open", "close", "volume")


_FROM, _TO = "2023-12-25", "2024-02-18"
_WEEKS = f"weeks AS (SELECT isoyear(m) AS year, week(m) AS week FROM (SELECT unnest(generate_series(TIMESTAMP '{_FROM}', TIMESTAMP '{_TO}', INTERVAL 7 DAY)) AS m))"
_SPINE = f"{fx.TRADES}, {fx.BARS}, {_WEEKS}, tickers AS (SELECT DISTINCT ticker FROM trades)"
_DONE = "done AS (SELECT ticker, year, week FROM tickers, weeks WHERE (week + length(ticker)) % 3 = 0)"


def _batches(spark, d):
    b = fx.bars(spark, d)
    return joins.weekly_batches(b, fx.trades(spark, d).select("ticker").distinct(), _FROM, _TO)


@query("weekly_batches", f"""WITH {_SPINE} SELECT t.ticker, CAST(w.year AS INT) AS year, CAST(w.week AS INT) AS week, CAST(count(b.symbol) AS INT) AS n_bars, epoch_us(min(b.ts)) AS first_us, arg_max(b.close, b.ts) AS last_close
FROM tickers t CROSS JOIN weeks w LEFT JOIN bars b ON b.symbol = t.ticker AND isoyear(b.ts) = w.year AND week(b.ts) = w.week GROUP BY 1, 2, 3""")
def weekly(spark, d):
    return _batches(spark, d).select("ticker", F.col("year").cast("int").alias("year"), "week", F.size("data").alias("n_bars"), times.micros(F.try_element_at("data", F.lit(1)).ts).alias("first_us"), F.try_element_at("data", F.lit(-1)).close.alias("last_close"))


def _done(batches):
    return batches.filter((F.col("week") + F.length("ticker")) % 3 == 0)


@query("week_coverage", f"WITH {_SPINE}, {_DONE} SELECT t.ticker, count(*) AS expected, count(d.week) AS processed, count(*) - count(d.week) AS missing FROM tickers t CROSS JOIN weeks w LEFT JOIN done d ON d.ticker = t.ticker AND d.year = w.year AND d.week = w.week GROUP BY 1")
def coverage(spark, d):
    b = _batches(spark, d)
    return joins.week_coverage(b, _done(b))


@query("pending_batches", f"WITH {_SPINE}, {_DONE} SELECT t.ticker, CAST(w.year AS INT) AS year, CAST(w.week AS INT) AS week FROM tickers t CROSS JOIN weeks w EXCEPT SELECT ticker, CAST(year AS INT), CAST(week AS INT) FROM done")
def pending(spark, d):
    b = _batches(spark, d)
    return joins.pending_batches(b, _done(b)).select("ticker", F.col("year").cast("int").alias("year"), "week")


@query("batch_explode", f"WITH {_SPINE} SELECT symbol AS ticker, CAST(week(ts) AS INT) AS week, epoch_us(ts) AS us, open, close, volume FROM bars WHERE ts >= TIMESTAMP '{_FROM}' AND ts < TIMESTAMP '2024-02-19'")
def batch_explode(spark, d):
    return joins.explode_batches(_batches(spark, d)).select("ticker", "week", times.micros("ts").alias("us"), "open", "close", "volume")


_LABEL = """label AS (SELECT f.event_id, t.price AS y1 FROM trades f ASOF LEFT JOIN (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id) = 1) t
 ON f.ticker = t.ticker AND f.ts + INTERVAL 1 MINUTE >= t.ts AND t.ts >= f.ts - INTERVAL 4 MINUTE)"""


def _labelled(spark, d):
    t = fx.trades(spark, d)
    return joins.label_next(t, t)


@query("label_asof", f"""WITH {fx.TRADES}, near AS (SELECT f.event_id, arg_max(t.price, (t.ts, -t.event_id)) AS y1 FROM trades f LEFT JOIN trades t ON f.ticker = t.ticker AND t.ts <= f.ts + INTERVAL 1 MINUTE AND t.ts >= f.ts - INTERVAL 4 MINUTE GROUP BY 1)
SELECT event_id, y1 FROM near""")
def label(spark, d):
    return _labelled(spark, d).select("event_id", "y1")


@query("first_in_minute", f"WITH {fx.TRADES} SELECT event_id, row_number() OVER (PARTITION BY ticker, date_trunc('minute', ts) ORDER BY ts, event_id) = 1 AS is_first FROM trades")
def first_minute(spark, d):
    first, rest = features.first_in_minute(fx.trades(spark, d), "event_id")
    return first.select("event_id", F.lit(True).alias("is_first")).unionByName(rest.select("event_id", F.lit(False).alias("is_first")))


_DAY = f"CAST({_NY} AS DATE)"
_REF = f"""ref AS (SELECT ticker, {_DAY} AS day, arg_min(price, (ts, event_id)) FILTER (WHERE {_SOD} >= 57600) AS c, arg_min(price, (ts, event_id)) FILTER (WHERE {_SOD} >= 34200) AS o, arg_min(price, (ts, event_id)) AS a, arg_max(price, (ts, event_id)) AS last_price FROM trades GROUP BY 1, 2)"""


@query("daily_reference", f"WITH {fx.TRADES}, {_REF} SELECT ticker, CAST(day AS VARCHAR) AS day, coalesce(c, o, a) AS reference, CASE WHEN c IS NOT NULL THEN 'close' WHEN o IS NOT NULL THEN 'open' ELSE 'first' END AS tier FROM ref")
def reference(spark, d):
    return serving.daily_reference(fx.trades(spark, d)).withColumn("day", F.col("day").cast("string"))


@query("daily_change", f"""WITH {fx.TRADES}, {_REF}, g AS (SELECT ticker, day, last_price, coalesce(c, o, a) AS r FROM ref) SELECT ticker, CAST(day AS VARCHAR) AS day, last_price, r AS reference, round(last_price - r, 6) AS change,
round(CASE WHEN r = 0 THEN NULL ELSE (last_price - r) / r * 100 END, 6) AS change_pct, CASE WHEN last_price > r THEN 'up' WHEN last_price < r THEN 'down' ELSE 'flat' END AS direction FROM g""")
def change(spark, d):
    return serving.daily_change(fx.trades(spark, d)).select("ticker", F.col("day").cast("string").alias("day"), "last_price", "reference", _r("change"), _r("change_pct"), "direction")


@query("latest_status", f"WITH {fx.TRADES} SELECT ticker, arg_max(exchange, (ts, event_id)) AS exchange, arg_max(price, (ts, event_id)) AS price FROM trades GROUP BY 1")
def status(spark, d):
    return features.latest(fx.trades(spark, d), "ticker", F.struct("ts", "event_id"), "exchange", "price")


@query("recent_prices", f"WITH {fx.TRADES} SELECT event_id, ticker, price FROM trades WHERE ts >= (SELECT max(ts) FROM trades) - INTERVAL 1 DAY")
def recent(spark, d):
    from ..operators.records import recent as within

    t = fx.trades(spark, d)
    asof = t.agg(F.max("ts")).first()[0]
    return within(t, F.lit(asof), "1 DAY", "ts").select("event_id", "ticker", "price")


@query("ticker_history", f"WITH {fx.TRADES} SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY ts, event_id) AS n, event_id FROM trades")
def history(spark, d):
    return spans.numbered(fx.trades(spark, d), ["ticker"], ["ts", "event_id"], spans.by_day()).select("ticker", "n", "event_id")


@query("grid_alignment", f"WITH {fx.TRADES} SELECT event_id, CAST((floor(epoch_us(ts) / 10000000) + 1) * 10 AS BIGINT) AS next_grid, second(ts) % 10 = 0 AS aligned FROM trades")
def alignment(spark, d):
    return fx.trades(spark, d).select("event_id", F.unix_seconds(times.next_grid("ts")).alias("next_grid"), times.on_grid("ts").alias("aligned"))


@query("warmup_suppressed", f"WITH {fx.TRADES} SELECT event_id, epoch_us(ts + INTERVAL 60 SECOND) AS target_us FROM trades WHERE NOT ({_SOD} >= 34140 AND {_SOD} < 34440 AND {_WD} < 5)")
def warmup(spark, d):
    return fx.trades(spark, d).filter(~times.in_warmup("ts")).select("event_id", times.micros(F.col("ts") + F.expr("INTERVAL 60 SECONDS")).alias("target_us"))


@query("monotonic_points", f"WITH {fx.TRADES}, o AS (SELECT *, (event_id * 7919) % 1000003 AS arrival FROM trades) SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY ticker ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o) WHERE before IS NULL OR ts > before")
def monotonic(spark, d):
    return features.monotonic(fx.trades(spark, d).withColumn("arrival", F.col("event_id") * 7919 % 1000003), "arrival", ties=("event_id",)).select("event_id")


@query("session_switch", registry_sql("grid_features_ffill").replace("SELECT ticker, simulated, cell * 600 AS at", "SELECT * FROM (SELECT ticker, simulated, cell * 600 AS at") + f""")
WHERE simulated = NOT (SELECT {_SOD} >= 34200 AND {_SOD} < 57600 AND {_WD} < 5 FROM (SELECT make_timestamp("at" * 1000000) AS ts))""")
def session_switch(spark, d):
    out = features.switch_by_session(features.grid_features(fx.trades(spark, d), 600, {"30min": 1800, "5h": 18000}))
    return out.select("ticker", F.col("is_simulated_prediction").alias("simulated"), F.unix_seconds("ts").alias("at"), _half_up("price_mean_30min", 4), _half_up("price_mean_5h", 4), "size_tot_30min", "size_tot_5h")

"""Queries over macro series, fundamentals and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import joins, records
from ..operators.features import WINDOWS
from ..schemas import FEATURES, MACRO_ALIASES, PRICE_FEATURES, SENTIMENT_FEATURES
from . import fixtures as fx
from .registry import query

_ALIASES = list(fx.PRIORITIES.values())


def _macro(spark, d):
    return records.clean_macro(fx.raw_macro(spark, d), 1996)


@query("macro_clean", f"WITH {fx.RAW_MACRO}, {fx.MACRO} SELECT series, CAST(date AS VARCHAR) AS date, value FROM macro")
def clean(spark, d):
    return _macro(spark, d).withColumn("date", F.col("date").cast("string"))


@query("macro_latest", f"WITH {fx.RAW_MACRO}, {fx.MACRO} SELECT series, CAST(max(date) AS VARCHAR) AS date, arg_max(value, date) AS value FROM macro GROUP BY 1")
def latest(spark, d):
    return records.macro_latest(_macro(spark, d)).withColumn("date", F.col("date").cast("string"))


_WIDE = ", ".join(f"max(value) FILTER (WHERE series = '{a}') AS {a}" for a in _ALIASES)


@query("macro_wide", f"WITH {fx.RAW_MACRO}, {fx.MACRO} SELECT CAST(date AS VARCHAR) AS date, {_WIDE} FROM macro GROUP BY date")
def wide(spark, d):
    return records.macro_wide(_macro(spark, d), _ALIASES).withColumn("date", F.col("date").cast("string"))


@query("macro_changes", f"WITH {fx.RAW_MACRO}, {fx.MACRO} SELECT series, CAST(date AS VARCHAR) AS date, value FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY date) AS b FROM macro) WHERE value IS DISTINCT FROM b")
def changes(spark, d):
    return records.macro_changes(_macro(spark, d)).select("series", F.col("date").cast("string").alias("date"), "value")


@query("macro_asof", f"""WITH {fx.RAW_MACRO}, {fx.MACRO}, {fx.DAILY_BARS}, """ + ", ".join(f"a_{a} AS (SELECT b.symbol, b.date, m.value AS {a} FROM daily_bars b ASOF LEFT JOIN (SELECT * FROM macro WHERE series = '{a}') m ON b.date >= m.date)" for a in _ALIASES)
+ " SELECT b.symbol, CAST(b.date AS VARCHAR) AS date, round(b.volume, 2) AS volume, " + ", ".join(_ALIASES) + " FROM daily_bars b " + " ".join(f"JOIN a_{a} USING (symbol, date)" for a in _ALIASES))
def asof(spark, d):
    out = joins.macro_asof(fx.daily_bars(spark, d).withColumnRenamed("date", "day"), _macro(spark, d), F.col("day"))
    return out.select("symbol", F.col("day").cast("string").alias("date"), F.round("volume", 2).alias("volume"), *_ALIASES)


_RATIOS = 'round(CASE WHEN revenue = 0 THEN NULL ELSE "netIncome" / revenue END, 6) AS profit_margin, round(CASE WHEN "balance_totalStockholdersEquity" = 0 THEN NULL ELSE "balance_totalDebt" / "balance_totalStockholdersEquity" END, 4) AS debt_to_equity'


@query("fundamentals_ratios", f'WITH {fx.FUNDAMENTALS} SELECT symbol, "calendarYear", loaded, {_RATIOS} FROM fundamentals')
def ratios(spark, d):
    return joins.ratios(fx.fundamentals(spark, d)).select("symbol", "calendarYear", "loaded", F.round("profit_margin", 6).alias("profit_margin"), F.round("debt_to_equity", 4).alias("debt_to_equity"))


@query("fundamentals_join", f"""WITH {fx.FUNDAMENTALS}, {fx.DAILY_BARS} SELECT b.symbol AS ticker, CAST(b.date AS VARCHAR) AS date, round(f.eps, 6) AS eps, {_RATIOS}
FROM daily_bars b LEFT JOIN (SELECT * FROM fundamentals WHERE loaded = 2) f ON f.symbol = b.symbol AND CAST(f."calendarYear" AS INT) = year(b.date) - 1""")
def fundamentals_join(spark, d):
    bars = fx.daily_bars(spark, d).withColumnRenamed("symbol", "ticker")
    out = joins.ratios(joins.join_fundamentals(bars, fx.fundamentals(spark, d), F.year("date") - 1))
    return out.select("ticker", F.col("date").cast("string").alias("date"), F.round("eps", 6).alias("eps"), F.round("profit_margin", 6).alias("profit_margin"), F.round("debt_to_equity", 4).alias("debt_to_equity"))


@query("fundamentals_pinned_year", f"""WITH {fx.FUNDAMENTALS} SELECT p.p_partkey, p.p_brand AS ticker, round(f.eps, 6) AS eps, f."cashflow_freeCashFlow" AS free_cash_flow
FROM part p LEFT JOIN (SELECT * FROM fundamentals WHERE loaded = 2 AND "calendarYear" = '1998') f ON f.symbol = p.p_brand""")
def pinned(spark, d):
    parts = fx.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    return joins.join_fundamentals(parts, fx.fundamentals(spark, d), F.lit(1998)).select("p_partkey", "ticker", F.round("eps", 6).alias("eps"), F.col("cashflow_freeCashFlow").alias("free_cash_flow"))


def _statements(spark, d):
    """Three statements of each nation's suppliers' orders, of unequal numbers: monthly sums of three statuses."""
    rows = fx.table(spark, d, "orders").withColumn("symbol", F.concat(F.lit("S"), F.col("o_custkey") % 20)).withColumn("date", F.to_date(F.date_trunc("QUARTER", "o_orderdate")))
    made = rows.groupBy("symbol", "date", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("amount"), F.count("*").alias("n"), F.min("o_orderkey").alias("id")).filter("n % 4 != 0 or o_orderstatus = 'F'")
    return [made.filter(F.col("o_orderstatus") == s).select("symbol", "date", "id", "amount") for s in ("F", "O", "P")]


_STATEMENTS = """made AS (SELECT 'S' || (o_custkey % 20) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, o_orderstatus AS st, round(sum(o_totalprice), 2) AS amount, count(*) AS n, min(o_orderkey) AS id FROM orders GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, st ORDER BY date DESC, id DESC) AS i FROM made WHERE n % 4 != 0 OR st = 'F')"""


@query("statement_merge", f"""WITH {_STATEMENTS}, f AS (SELECT * FROM r WHERE st = 'F' AND i <= 10), o AS (SELECT * FROM r WHERE st = 'O' AND i <= 10), p AS (SELECT * FROM r WHERE st = 'P' AND i <= 10)
SELECT coalesce(f.symbol, o.symbol, p.symbol) AS symbol, CAST(coalesce(f.i, o.i, p.i) AS INT) AS "reportIndex", CAST(coalesce(f.date, o.date, p.date) AS VARCHAR) AS "reportDate", f.amount AS amount, o.amount AS balance_amount, p.amount AS cashflow_amount
FROM f FULL JOIN o ON f.symbol = o.symbol AND f.i = o.i FULL JOIN p ON coalesce(f.symbol, o.symbol) = p.symbol AND coalesce(f.i, o.i) = p.i""")
def statements(spark, d):
    return joins.merge_statements(*_statements(spark, d)).select("symbol", "reportIndex", F.col("reportDate").cast("string").alias("reportDate"), "amount", "balance_amount", "cashflow_amount")


@query("year_correction", """WITH s AS (SELECT s_suppkey AS id, 'S' || s_nationkey AS symbol, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE CAST(2015 + s_suppkey % 11 AS VARCHAR) END AS y FROM supplier),
h AS (SELECT *, max(coalesce(TRY_CAST(y AS INT) = 2025, false)) OVER (PARTITION BY symbol) AS hit, max(coalesce(TRY_CAST(y AS INT) = 2025, false)) OVER () AS any_hit FROM s)
SELECT id, symbol, CASE WHEN any_hit THEN CAST(coalesce(CASE WHEN hit THEN TRY_CAST(y AS INT) - 1 ELSE TRY_CAST(y AS INT) END, 0) AS VARCHAR) ELSE y END AS "calendarYear" FROM h""")
def year_correction(spark, d):
    key = F.col("s_suppkey")
    rows = fx.table(spark, d, "supplier").select(key.alias("id"), F.concat(F.lit("S"), "s_nationkey").alias("symbol"), F.when(key % 13 == 0, None).otherwise((key % 11 + 2015).cast("string")).alias("calendarYear"))
    return joins.shift_years(rows, 2025)


_CONTEXT = """context AS (SELECT event_id AS cid, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS cpi, value * 2 AS ffr FROM events WHERE event_id % 50 = 7)"""


def _context(spark, d):
    e = fx.table(spark, d, "events").filter("event_id % 50 = 7")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("cpi"), (F.col("value") * 2).alias("ffr"))


@query("context_merge", f"WITH {fx.TRADES}, {_CONTEXT} SELECT t.event_id, t.price, coalesce(c.cpi, 0) AS cpi, coalesce(c.ffr, 0) AS ffr FROM trades t ASOF JOIN context c ON t.ts >= c.ts")
def context(spark, d):
    return joins.merge_context(fx.trades(spark, d).select("event_id", "ticker", "ts", "price"), _context(spark, d), ["cpi", "ffr"]).select("event_id", "price", "cpi", "ffr")


@query("context_by_step", f"""WITH {fx.TRADES}, {_CONTEXT}, s AS (SELECT floor(epoch_us(ts) / 600000000) AS cell, arg_max(ffr, ts) AS ffr FROM context GROUP BY 1)
SELECT t.event_id, s.ffr FROM trades t ASOF LEFT JOIN s ON floor(epoch_us(t.ts) / 600000000) > s.cell""")
def context_by_step(spark, d):
    return joins.latest_context_join(fx.trades(spark, d), _context(spark, d), 600, ["ffr"]).select("event_id", "ffr")


def _training_macro(spark, d):
    """The macro series moved to the trades' years."""
    return _macro(spark, d).withColumn("date", F.add_months("date", 12 * 26))


def _training_fundamentals(spark, d):
    """The fundamentals of brands as those of the tickers that their numbers stand for, moved to the trades' years."""
    made = fx.fundamentals(spark, d)
    names = F.element_at(F.array(*[F.lit(t) for t in fx.TICKERS]), F.regexp_extract("symbol", "([0-9]+)", 1).cast("int") % 5 + 1)
    return made.withColumn("loaded", F.concat_ws("/", "symbol", "loaded")).withColumn("symbol", names).withColumn("calendarYear", (F.col("calendarYear").cast("int") + 25).cast("string"))


def _training_sql() -> str:
    made = []
    for name in PRICE_FEATURES:
        kind, _, window = name.rpartition("_")
        over = f"OVER (PARTITION BY symbol, isoyear(ts), week(ts) ORDER BY ts RANGE BETWEEN INTERVAL {WINDOWS[window]} SECOND PRECEDING AND CURRENT ROW)"
        made.append({"price_mean": f"round(avg(open) {over} + 1e-9, 6)", "price_std": f"round(coalesce(stddev_pop(open) {over}, 0), 4)", "size_tot": f"coalesce(sum(volume) {over}, 0)"}[kind] + f" AS {name}")
    wall = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"
    series = [f"m_{a} AS (SELECT d.day, m.value AS {a} FROM days d ASOF LEFT JOIN (SELECT * FROM moved WHERE series = '{a}') m ON d.day >= m.date)" for a in MACRO_ALIASES]
    return f"""WITH {fx.TRADES}, {fx.BARS}, {fx.FUNDAMENTALS}, {fx.RAW_MACRO}, {fx.MACRO}, moved AS (SELECT series, CAST(date + INTERVAL 26 YEAR AS DATE) AS date, value FROM macro),
rows AS (SELECT symbol AS ticker, ts, close, CAST(ts AS DATE) AS day, epoch_us({wall}) - epoch_us(date_trunc('day', {wall})) - 34200000000 AS us, {", ".join(made)} FROM bars),
days AS (SELECT DISTINCT day FROM rows), {", ".join(series)},
named AS (SELECT *, [{", ".join(f"'{t}'" for t in fx.TICKERS)}][CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT) % 5 + 1] AS ticker, CAST("calendarYear" AS INT) + 25 AS y FROM fundamentals),
f AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY ticker, y ORDER BY symbol || '/' || loaded DESC) = 1)
SELECT r.ticker, epoch_us(r.ts) AS timestamp_us, {", ".join(f"r.{c}" for c in PRICE_FEATURES)}, {", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in SENTIMENT_FEATURES)},
CAST(greatest(floor(us / 60000000.0), 0) AS DOUBLE) AS minutes_since_open, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(day(ts) AS INT) AS day_of_month, CAST(week(ts) AS INT) AS week_of_year, CAST(month(ts) AS INT) AS month_of_year,
CAST(us >= 0 AND us <= 240000000 AS INT) AS market_open_spike_flag, CAST(us >= 23160000000 AND us <= 23400000000 AS INT) AS market_close_spike_flag,
round(f.eps, 6) AS eps, f."cashflow_freeCashFlow" AS free_cash_flow, {_RATIOS}, {", ".join(MACRO_ALIASES)}, r.close AS y1
FROM rows r LEFT JOIN f ON f.ticker = r.ticker AND f.y = year(r.ts) - 1 {" ".join(f"JOIN m_{a} ON m_{a}.day = r.day" for a in MACRO_ALIASES)}"""


@query("training_table", _training_sql())
def training_table(spark, d):
    out = joins.training_table(fx.bars(spark, d), _training_macro(spark, d), _training_fundamentals(spark, d))
    rounded = {c: F.round(F.col(c) + 1e-9, 6) for c in PRICE_FEATURES if c.startswith("price_mean")} | {c: F.round(c, 4) for c in (*PRICE_FEATURES, "debt_to_equity") if c.startswith(("price_std", "debt"))}
    out = out.withColumns(rounded | {"eps": F.round("eps", 6), "profit_margin": F.round("profit_margin", 6)})
    return out.select("ticker", micros("timestamp").alias("timestamp_us"), *FEATURES, "y1")

"""Joins of the feature pipeline: as-of, next-minute labels, context, fundamentals, statements, weekly spines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.times import micros
from ..schemas import FEATURES, FUNDAMENTAL_FEATURES, MACRO_ALIASES
from .spans import DAY, last_before

MINUTE = 60_000_000
#: Length of the time buckets of as-of joins.
BUCKET = 60 * MINUTE


def asof_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, by: list[str], values: list[str], tie: Column, tolerance: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """Each left row with the values of the newest right row of its key with right_ts <= left_ts, at most `tolerance` microseconds before.

    Both sides go into one sorted stream by key and time bucket (`bucket` microseconds) and the last right row is carried forward, so a hot key is
    many tasks; a bucket opens with the last right row of the buckets before it, of which one row each is compared by key. No range join. On equal times the
    greatest `tie` (a column of the right side) wins. Without a match the values are null.
    """
    a = left.select(*by, micros(left_ts).alias("_us"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), F.struct(*left.columns).alias("_row"), F.lit(None).alias("_held"))
    b = right.select(*by, micros(right_ts).alias("_us"), F.lit(0).alias("_side"), tie.alias("_tie"), F.lit(None).alias("_row"), F.struct(micros(right_ts).alias("at"), *values).alias("_held"))
    both = a.unionByName(b).withColumn("_bucket", F.floor(F.col("_us") / bucket))
    ends = both.groupBy(*by, "_bucket").agg(F.max_by(F.col("_held"), F.when(F.col("_side") == 0, F.struct("_us", "_tie"))).alias("_held"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    opening = ends.withColumn("_held", F.last("_held", ignorenulls=True).over(before)).filter("_held is not null").withColumn("_us", F.col("_bucket") * bucket).withColumn("_side", F.lit(-1))
    order = W.partitionBy(*by, "_bucket").orderBy("_us", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    held = F.last("_held", ignorenulls=True).over(order)
    out = both.unionByName(opening, allowMissingColumns=True).withColumn("_held", held).filter("_side = 1")
    if tolerance is not None:
        out = out.withColumn("_held", F.when(F.col("_us") - F.col("_held.at") <= tolerance, F.col("_held")))
    return out.select("_row.*", *[F.col(f"_held.{v}").alias(v) for v in values])


def label_next(features: DataFrame, trades: DataFrame, horizon: int = MINUTE, lookback: int = 5 * MINUTE, arrival: str = "event_id") -> DataFrame:
    """Each feature row with y1: the price of the newest trade in [t + horizon - lookback, t + horizon]; of equal times the first arrival."""
    aimed = features.withColumn("_aim", F.timestamp_micros(micros("ts") + horizon))
    found = asof_join(aimed, trades.select("ticker", F.col("ts").alias("_at"), F.col("price").alias("y1"), F.col(arrival).alias("_arrival")), "_aim", "_at", ["ticker"], ["y1"], -F.col("_arrival"), lookback)
    return found.drop("_aim")


def interval_label(features: DataFrame, trades: DataFrame, horizon: int = MINUTE, lookback: int = 5 * MINUTE) -> DataFrame:
    """The stream form: an interval join and the newest price of each feature row, as watermarks can release it. Rows without a trade are left out."""
    t = trades.select(F.col("ticker").alias("_ticker"), F.col("ts").alias("_at"), F.col("price").alias("_price"))
    near = (F.col("ticker") == F.col("_ticker")) & F.expr(f"_at >= ts + INTERVAL {(horizon - lookback) // 1_000_000} SECONDS AND _at <= ts + INTERVAL {horizon // 1_000_000} SECONDS")
    return features.join(t, near)


def valid_until(values: DataFrame, by: str, date: str) -> DataFrame:
    """Each dated value with the next entry's date of its series: the interval in which it is the newest."""
    return values.withColumn("until", F.lead(date).over(W.partitionBy(by).orderBy(date)))


def macro_asof(df: DataFrame, macro: DataFrame, date: Column) -> DataFrame:
    """df with a column for each macro series: the newest value dated on or before `date`; of two on one day the larger; null before the first.

    The macro table is one wide row a date (days, not ticks), carried forward before the join.
    """
    daily = macro.groupBy("date").pivot("series", list(MACRO_ALIASES)).agg(F.max("value"))
    order = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    filled = daily.select("date", *[F.last(c, ignorenulls=True).over(order).alias(c) for c in MACRO_ALIASES], F.lead("date").over(W.orderBy("date")).alias("until"))
    on = (F.col("_date") >= F.col("date")) & (F.col("until").isNull() | (F.col("_date") < F.col("until")))
    days = df.withColumn("_date", date)
    known = days.select("_date").distinct().join(F.broadcast(filled), on, "left").drop("date", "until")
    return days.join(known, "_date", "left").drop("_date")


def join_fundamentals(df: DataFrame, fundamentals: DataFrame, year: Column) -> DataFrame:
    """df with the fundamentals of (symbol, year); of duplicates the last loaded (greatest `loaded`) counts."""
    last = fundamentals.groupBy("symbol", "calendarYear").agg(F.max_by(F.struct(*[c for c in fundamentals.columns if c not in ("symbol", "calendarYear")]), "loaded").alias("f"))
    last = last.select(F.col("symbol").alias("ticker"), F.col("calendarYear").try_cast("int").alias("_year"), "f.*").filter("_year is not null").drop("loaded")
    return df.withColumn("_year", year).join(last, ["ticker", "_year"], "left").drop("_year")


def ratios(df: DataFrame) -> DataFrame:
    return df.withColumn("profit_margin", ratio("netIncome", "revenue")).withColumn("debt_to_equity", ratio("balance_totalDebt", "balance_totalStockholdersEquity"))


def merge_context(features: DataFrame, context: DataFrame, fields: list[str], require_context: bool = True) -> DataFrame:
    """Feature rows with the newest global context at their time; a context field that is missing counts as 0.0.

    With `require_context` nothing comes out before the first context.
    """
    one = context.select("ts", *fields).withColumn("_key", F.lit(1)).withColumn("_seen", F.lit(True))
    out = asof_join(features.withColumn("_key", F.lit(1)).withColumnRenamed("ts", "_fts"), one, "_fts", "ts", ["_key"], ["_seen", *fields], F.lit(0))
    out = out.filter("_seen") if require_context else out
    return out.select(*[F.coalesce(c, F.lit(0.0)).alias(c) if c in fields else F.col(c) for c in out.columns if c not in ("_key", "_seen")]).withColumnRenamed("_fts", "ts")


def latest_context_join(features: DataFrame, context: DataFrame, step: int, fields: list[str]) -> DataFrame:
    """The scalable context join: context resampled to one row a `step` seconds and carried forward, then an equality join on the step.

    Steps are carried forward inside a day each, and from day to day by one row of each.
    """
    cell = F.floor(micros("ts") / (step * 1_000_000))
    newest = context.withColumn("cell", cell).groupBy("cell").agg(*[F.max_by(c, micros("ts")).alias(c) for c in fields])
    steps = features.select(cell.alias("cell")).distinct().join(newest, "cell", "full")
    known = last_before(steps, [], "cell", F.floor(F.col("cell") * step / DAY), fields)
    return features.withColumn("cell", cell).join(known, "cell", "left").drop("cell")


def ranked_reports(df: DataFrame, limit: int = 10) -> DataFrame:
    """Reports of each symbol numbered from 1, newest first, at most `limit`."""
    return df.withColumn("reportIndex", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date"), F.desc("id")))).filter(F.col("reportIndex") <= limit)


def merge_statements(income: DataFrame, balance: DataFrame, cashflow: DataFrame, limit: int = 10) -> DataFrame:
    """The three statements of a symbol side by side by position; balance and cash-flow columns get a prefix; the first date known is the report's."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return ranked_reports(df, limit).select("symbol", "reportIndex", *[F.col(c).alias(prefix + c) for c in df.columns if c != "symbol"])

    both = side(income, "").join(side(balance, "balance_"), ["symbol", "reportIndex"], "full").join(side(cashflow, "cashflow_"), ["symbol", "reportIndex"], "full")
    return both.withColumn("reportDate", F.coalesce("date", "balance_date", "cashflow_date"))


def shift_years(df: DataFrame, trigger: int) -> DataFrame:
    """A symbol with any report in the trigger year has all its years less by one; a year that is no number becomes '0'. Without any such symbol years stay."""
    year = F.col("calendarYear").try_cast("int")
    hit = F.max(F.coalesce(year == trigger, F.lit(False))).over(W.partitionBy("symbol"))
    marked = df.withColumn("_hit", hit)
    any_hit = df.filter(year == trigger).select(F.lit(True).alias("_any")).limit(1)
    out = marked.join(F.broadcast(any_hit), F.lit(True), "left")
    moved = F.coalesce(F.when(F.col("_hit"), year - 1).otherwise(year), F.lit(0)).cast("string")
    return out.withColumn("calendarYear", F.when(F.col("_any"), moved).otherwise(F.col("calendarYear"))).drop("_hit", "_any")


def weekly_batches(bars: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """A row for each ticker and ISO week between the dates, with its bars in order of time, an empty array where there are none."""
    weeks = tickers.sparkSession.range(1).select(F.explode(F.sequence(F.date_trunc("WEEK", F.lit(start).cast("date")), F.lit(end).cast("date").cast("timestamp"), F.expr("INTERVAL 7 DAYS"))).alias("monday"))
    weeks = weeks.select(F.expr("extract(YEAROFWEEK FROM monday)").alias("year"), F.weekofyear("monday").alias("week"))
    spine = tickers.select("ticker").join(F.broadcast(weeks))
    held = bars.groupBy(F.col("symbol").alias("ticker"), F.expr("extract(YEAROFWEEK FROM ts)").alias("year"), F.weekofyear("ts").alias("week")).agg(F.sort_array(F.collect_list(F.struct("ts", "open", "close", "volume"))).alias("data"))
    none = F.array().cast(held.schema["data"].dataType)
    return spine.join(held, ["ticker", "year", "week"], "left").withColumn("data", F.coalesce("data", none))


def explode_batches(batches: DataFrame) -> DataFrame:
    return batches.select("ticker", "year", "week", F.explode("data").alias("b")).select("ticker", "year", "week", "b.*")


def week_coverage(batches: DataFrame, done: DataFrame) -> DataFrame:
    """Expected batches of each ticker, those done and those missing."""
    keyed = batches.select("ticker", "year", "week").join(done.select("ticker", "year", "week", F.lit(1).alias("_done")), ["ticker", "year", "week"], "left")
    return keyed.groupBy("ticker").agg(F.count("*").alias("expected"), F.count("_done").alias("processed"), F.count_if(F.col("_done").isNull()).alias("missing"))


def pending_batches(batches: DataFrame, done: DataFrame) -> DataFrame:
    return batches.join(done.select("ticker", "year", "week"), ["ticker", "year", "week"], "left_anti")


def all_there(series: set[str], fundamentals: bool, required: tuple[str, ...] = MACRO_ALIASES) -> bool:
    """Whether dimensions suffice: every required macro series and some fundamentals."""
    return fundamentals and series >= set(required)


def context_ready(macro: DataFrame, fundamentals: DataFrame, required: tuple[str, ...] = MACRO_ALIASES) -> bool:
    """Whether every macro series and some fundamentals are there, before a stream is started."""
    seen = {r[0] for r in macro.filter(F.col("series").isin(*required)).select("series").distinct().collect()}
    return all_there(seen, not fundamentals.isEmpty(), required)


def join_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Rows whose ticker has parameters, with them; others go."""
    return df.join(params, "ticker")


def ticker_codes(df: DataFrame) -> DataFrame:
    """Codes from 0 without gaps, by ticker."""
    return df.select("ticker").distinct().withColumn("code", F.row_number().over(W.orderBy("ticker")) - 1)


def training_table(bars: DataFrame, macro: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """The 35-column row of every bar: features in its ISO week, calendar, last year's fundamentals, macro as of its date; y1 is its close."""
    from ..functions.times import calendar_features
    from .features import trailing_features

    rows = trailing_features(bars.withColumnRenamed("symbol", "ticker"), price="open", size="volume")
    rows = rows.select("*", *calendar_features("ts", "batch"))
    rows = ratios(join_fundamentals(rows, fundamentals, F.year("ts") - 1))
    rows = macro_asof(rows, macro, F.to_date("ts"))
    from ..schemas import SENTIMENT_FEATURES

    rows = rows.withColumns({c: F.lit(0.0) for c in SENTIMENT_FEATURES}).withColumn("free_cash_flow", F.col("cashflow_freeCashFlow")).withColumn("minutes_since_open", F.col("minutes_since_open").cast("double"))
    assert set(FUNDAMENTAL_FEATURES) <= set(rows.columns)
    return rows.select("ticker", F.col("ts").alias("timestamp"), *FEATURES, F.col("close").alias("y1"))

"""The record shapes of the engine, as views of the driver's tables, in Spark and as common table expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MACRO_ALIASES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(table(spark, sf_dir, "events"))


def trades_of(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", F.upper("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"),
        F.regexp_extract("props", "([0-9]+)", 1).try_cast("double").alias("size"), F.when(F.col("user_id") % 5 == 0, "RANDOM").otherwise("V").alias("exchange"),
        (F.col("user_id") % 5 == 0).alias("simulated"),
    )


TRADES = """trades AS (SELECT event_id, upper(event_type) AS ticker, ts, value AS price, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS size,
 CASE WHEN user_id % 5 = 0 THEN 'RANDOM' ELSE 'V' END AS exchange, user_id % 5 = 0 AS simulated FROM events)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of trades."""
    return (
        trades(spark, sf_dir)
        .groupBy(F.col("ticker").alias("symbol"), F.date_trunc("MINUTE", "ts").alias("ts"))
        .agg(F.min_by("price", F.struct("ts", "event_id")).alias("open"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("size").alias("volume"))
    )


BARS = """bars AS (SELECT ticker AS symbol, date_trunc('minute', ts) AS ts, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS close, sum(size) AS volume
 FROM trades GROUP BY 1, 2)"""


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of brands."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("date"))
        .agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))
    )


DAILY_BARS = """daily_bars AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close, sum(l_quantity) AS volume
 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly fundamentals of brands; a few divisors are 0 by a rule, and each report is loaded twice, the second time with more eps."""
    year = F.year("l_shipdate")
    made = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(F.col("p_brand").alias("symbol"), year.alias("y"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("r"), F.round(F.sum(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))), 2).alias("netIncome"),
            F.round(F.sum(F.col("l_extendedprice") * F.col("l_tax")), 2).alias("balance_totalDebt"), F.round(F.sum(F.col("l_quantity")), 2).alias("q"), F.count("*").alias("n"),
        )
    )
    return made.select(
        "symbol", F.col("y").cast("string").alias("calendarYear"), F.explode(F.array(F.lit(1), F.lit(2))).alias("loaded"), "netIncome", "balance_totalDebt",
        F.when(F.col("n") % 10 == 0, 0.0).otherwise(F.col("r")).alias("revenue"), F.when(F.col("n") % 7 == 0, None).otherwise(F.col("q")).alias("balance_totalStockholdersEquity"),
        (F.col("n") * 0.5).alias("cashflow_freeCashFlow"), F.col("n").alias("n"),
    ).withColumn("eps", F.col("n") * 0.01 * F.col("loaded")).drop("n")


FUNDAMENTALS = """fundamentals AS (SELECT symbol, CAST(y AS VARCHAR) AS "calendarYear", loaded, "netIncome", "balance_totalDebt", CASE WHEN n % 10 = 0 THEN 0.0 ELSE r END AS revenue,
 CASE WHEN n % 7 = 0 THEN NULL ELSE q END AS "balance_totalStockholdersEquity", n * CAST(0.5 AS DOUBLE) AS "cashflow_freeCashFlow", n * CAST(0.01 AS DOUBLE) * loaded AS eps
 FROM (SELECT p_brand AS symbol, year(l_shipdate) AS y, round(sum(l_extendedprice), 2) AS r, round(sum(l_extendedprice * (l_discount - l_tax)), 2) AS "netIncome",
 round(sum(l_extendedprice * l_tax), 2) AS "balance_totalDebt", round(sum(l_quantity), 2) AS q, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), (VALUES (1), (2)) AS v(loaded))"""

#: The aliases of macro series that the order priorities stand for.
PRIORITIES = {"1-URGENT": "cpi", "2-HIGH": "ffr", "3-MEDIUM": "t10y", "4-NOT SPECIFIED": "t2y", "5-LOW": "unemployment"}


def raw_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly observations with the value as text, `.` where none was published."""
    alias = F.coalesce(*[F.when(F.col("o_orderpriority") == k, v) for k, v in PRIORITIES.items()])
    made = table(spark, sf_dir, "orders").groupBy(alias.alias("series"), F.to_date(F.date_trunc("MONTH", "o_orderdate")).alias("date")).agg(F.round(F.avg("o_totalprice") / 100000, 1).alias("v"), F.count("*").alias("n"))
    return made.select("series", "date", F.when(F.col("n") % 11 == 0, ".").otherwise(F.format_string("%.1f", "v")).alias("value"))


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items())
RAW_MACRO = f"""raw_macro AS (SELECT series, date, CASE WHEN n % 11 = 0 THEN '.' ELSE printf('%.1f', v) END AS value FROM (SELECT CASE o_orderpriority {_CASE} END AS series,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) / 100000, 1) AS v, count(*) AS n FROM orders GROUP BY 1, 2))"""
MACRO = "macro AS (SELECT series, date, TRY_CAST(value AS DOUBLE) AS value FROM raw_macro WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL AND year(date) >= 1996)"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event types as active companies, the nations as inactive ones, with related words."""
    events = table(spark, sf_dir, "events").select(F.upper("event_type").alias("ticker")).distinct()
    active = events.select((F.crc32("ticker") % 100000).cast("int").alias("ticker_id"), "ticker", F.initcap("ticker").alias("company_name"), F.concat(F.lit("the "), F.lower("ticker"), F.lit(", x ,"), F.lower("ticker"), F.lit("s")).alias("related_words"), F.lit(True).alias("is_active"), F.lit(100).alias("avg_simulated_price"))
    other = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 200000).cast("int").alias("ticker_id"), F.concat(F.lit("N"), "n_nationkey").alias("ticker"), F.col("n_name").alias("company_name"), F.lit(None).cast("string").alias("related_words"), F.lit(False).alias("is_active"), F.lit(None).cast("int").alias("avg_simulated_price"))
    return active.unionByName(other)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_of(table(spark, sf_dir, "documents"))


def posts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), "text", "source", F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") * 7919) % 2592000).alias("ts"), F.when(F.col("doc_id") % 2 == 0, "bluesky").otherwise("news").alias("social"))


POSTS = """posts AS (SELECT doc_id AS id, text, source, make_timestamp((1704067200 + (doc_id * 7919) % 2592000) * 1000000) AS ts, CASE WHEN doc_id % 2 = 0 THEN 'bluesky' ELSE 'news' END AS social FROM documents)"""

TICKERS = ("CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW")


def with_tickers(scored: DataFrame) -> DataFrame:
    """Posts with the ticker array that their id stands for."""
    return scored.withColumn("ticker", F.array(F.element_at(F.array(*[F.lit(t) for t in (*TICKERS, "GENERAL")]), (F.col("id") % 6 + 1).cast("int"))))


assert set(PRIORITIES.values()) <= set(MACRO_ALIASES)

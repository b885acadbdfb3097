"""Queries on validation, deduplication, filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import joins, records
from . import fixtures as fx
from .registry import query


@query("json_validate", """WITH e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN substr(props, 1, 5) ELSE props END AS value FROM events) SELECT event_id, CASE WHEN json_valid(value) THEN CAST(json_extract(value, '$.k') AS BIGINT) END AS k, NOT json_valid(value) AS bad FROM e""")
def json_validate(spark, d):
    raw = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("value"))
    parts = records.split_shapes(raw, {"props": ("k long", ["k"])})
    return parts["props"].select("event_id", "k", F.lit(False).alias("bad")).unionByName(parts["bad"].select("event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("bad")))


@query("dedupe_by_id", "SELECT url, page_id FROM (SELECT url, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS r FROM (SELECT split_part(url, '?', 1) AS url, page_id FROM pages)) WHERE r = 1")
def dedupe(spark, d):
    pages = fx.table(spark, d, "pages").select(F.substring_index("url", "?", 1).alias("url"), "page_id")
    return records.dedupe(pages, ["url"], F.col("page_id"))


@query("upsert_keep_last", f"""WITH {fx.TRADES}, k AS (SELECT ticker, date_trunc('hour', ts) AS h, event_id, price, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS new FROM trades)
SELECT ticker, epoch_us(h) AS hour_us, arg_max(event_id, (new, event_id)) AS event_id, arg_max(price, (new, event_id)) AS price FROM k GROUP BY 1, 2""")
def upsert(spark, d):
    rows = fx.trades(spark, d).select("ticker", micros(F.date_trunc("HOUR", "ts")).alias("hour_us"), "event_id", "price")
    return records.upsert_rows(rows.filter("event_id % 3 != 0"), rows.filter("event_id % 3 = 0"), ["ticker", "hour_us"], "event_id")


_DIRTY = "dirty AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS price, CASE WHEN event_id % 17 = 0 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 13 = 0 THEN 'x' || event_type ELSE CAST(value AS VARCHAR) END AS raw FROM events)"


def _dirty(spark, d):
    e = fx.table(spark, d, "events")
    return e.select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("value")).alias("price"), F.when(F.col("event_id") % 17 != 0, F.col("user_id")).alias("user_id"))


@query("null_profile", f"WITH {_DIRTY} SELECT count(*) AS n_rows, count(*) FILTER (WHERE price IS NOT NULL AND user_id IS NOT NULL) AS n_complete, count(*) - count(event_id) AS null_event_id, count(*) - count(price) AS null_price, count(*) - count(user_id) AS null_user_id FROM dirty")
def null_profile(spark, d):
    return records.null_profile(_dirty(spark, d))


@query("complete_rows", f"WITH {_DIRTY} SELECT event_id, price, user_id FROM dirty WHERE price IS NOT NULL AND user_id IS NOT NULL")
def complete(spark, d):
    return records.complete_rows(_dirty(spark, d))


@query("incomplete_rows", f"WITH {_DIRTY} SELECT event_id, price, user_id FROM dirty WHERE price IS NULL OR user_id IS NULL ORDER BY event_id LIMIT 5")
def incomplete(spark, d):
    return records.incomplete_rows(_dirty(spark, d), 5, "event_id")


@query("numeric_coercion", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) / 4 END AS x FROM events")
def coercion(spark, d):
    e = fx.table(spark, d, "events")
    raw = e.select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("x"), "event_type")).otherwise((F.col("event_id") / 4).cast("string")).alias("x"))
    return records.to_numeric(raw, ["x"])


@query("required_fields", "SELECT event_id, NOT (event_id % 7 = 0 OR event_id % 9 = 0) AS good FROM events")
def required(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 9 == 0, F.array().cast("array<string>")).otherwise(F.array("event_type")).alias("kinds"))
    good, bad = records.require(e, "kind", "kinds")
    return good.select("event_id", F.lit(True).alias("good")).unionByName(bad.select("event_id", F.lit(False).alias("good")))


@query("active_companies", "SELECT DISTINCT upper(event_type) AS ticker, upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) AS company_name FROM events")
def active(spark, d):
    return fx.companies(spark, d).filter("is_active").orderBy("ticker_id").select("ticker", "company_name")


@query("ticker_codes", "SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) - 1 AS INT) AS code FROM (SELECT DISTINCT upper(event_type) AS ticker FROM events)")
def codes(spark, d):
    return joins.ticker_codes(fx.trades(spark, d))


@query("ticker_params", f"WITH {fx.TRADES}, p AS (SELECT ticker, CAST(row_number() OVER (ORDER BY ticker) - 1 AS INT) AS code FROM (SELECT DISTINCT ticker FROM trades)) SELECT t.event_id, p.code FROM trades t JOIN p ON p.ticker = t.ticker WHERE p.code < 3")
def params(spark, d):
    t = fx.trades(spark, d)
    return joins.join_params(t, joins.ticker_codes(t).filter("code < 3")).select("event_id", "code")


@query("ticker_whitelist", f"WITH {fx.TRADES} SELECT event_id, ticker FROM trades WHERE ticker IN ('CLICK', 'VIEW')")
def whitelist(spark, d):
    keep = fx.companies(spark, d).filter("is_active and ticker in ('CLICK', 'VIEW')")
    return records.keep_tickers(fx.trades(spark, d), keep).select("event_id", "ticker")


@query("real_predictions", f"WITH {fx.TRADES} SELECT event_id, prediction FROM (SELECT event_id, simulated, CASE WHEN event_id % 9 = 0 THEN 0.0 WHEN event_id % 10 = 0 THEN NULL ELSE price END AS prediction FROM trades) WHERE NOT simulated AND prediction IS NOT NULL AND prediction != 0")
def real(spark, d):
    key = F.col("event_id")
    p = fx.trades(spark, d).select("event_id", F.when(key % 9 == 0, 0.0).when(key % 10 != 0, F.col("price")).alias("prediction"), F.col("simulated").alias("is_simulated_prediction"))
    return records.real_only(p).select("event_id", "prediction")


@query("storage_projection", "SELECT doc_id AS id, coalesce(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END, 'unknown') AS subreddit, coalesce(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END, '') AS lang, CAST(0.0 AS DOUBLE) AS score FROM documents")
def projection(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("subreddit"), F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    return records.ordered_projection(docs, [("id", 0), ("subreddit", "unknown"), ("lang", ""), ("score", 0.0)])


@query("record_json", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '{\"doc_id\":' || doc_id || '}' ELSE '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' END AS record FROM documents")
def record_json(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"))
    return docs.select("doc_id", records.to_record(docs).alias("record"))


@query("union_topics", f"WITH {fx.TRADES}, {fx.POSTS} SELECT 't' || event_id AS key, price, NULL AS social FROM trades UNION ALL SELECT 'p' || id, NULL, social FROM posts")
def union(spark, d):
    t = fx.trades(spark, d).select(F.concat(F.lit("t"), "event_id").alias("key"), "price")
    return records.union_records(t, fx.posts(spark, d).select(F.concat(F.lit("p"), "id").alias("key"), "social"))


@query("record_keys", f"WITH {fx.TRADES}, {fx.RAW_MACRO} SELECT key, count(*) AS n FROM (SELECT ticker AS key FROM trades UNION ALL SELECT series FROM raw_macro) GROUP BY 1")
def record_keys(spark, d):
    both = records.union_records(fx.trades(spark, d).select("ticker"), fx.raw_macro(spark, d).select("series"))
    return both.groupBy(records.record_key(both).alias("key")).agg(F.count("*").alias("n"))

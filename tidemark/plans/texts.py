"""Queries over posts: tickers, keywords and sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, times
from ..operators import features, records, text, wordmodel
from . import fixtures as fx
from .registry import query

_KEYWORDS = "kw AS (SELECT item_id, lower(text) AS keyword FROM benchmark)"


@query("keyword_dim", """WITH a AS (SELECT DISTINCT upper(event_type) AS ticker FROM events), w AS (SELECT ticker, lower(trim(k)) AS keyword FROM (SELECT ticker, unnest([lower(ticker), 'the ' || lower(ticker), ' x ', lower(ticker) || 's']) AS k FROM a)),
n AS (SELECT 'N' || n_nationkey AS ticker, lower(n_name) AS keyword FROM nation) SELECT keyword, ticker FROM w WHERE length(keyword) > 1 UNION SELECT keyword, ticker FROM n WHERE length(keyword) > 1 UNION SELECT 'stocks', 'GENERAL'""")
def keyword_dim(spark, d):
    return text.keyword_dim(fx.companies(spark, d), (("GENERAL", " Stocks"), ("GENERAL", "q"))).select("keyword", "ticker")


@query("keyword_match", f"WITH {_KEYWORDS} SELECT doc_id, item_id FROM documents d JOIN kw ON contains(lower(d.text), keyword)")
def keyword_match(spark, d):
    kw = fx.table(spark, d, "benchmark").select("item_id", F.lower("text").alias("keyword"))
    return text.keyword_match(fx.table(spark, d, "documents").select("doc_id", "text"), kw.select("item_id", "keyword")).select("doc_id", "item_id")


_TAGGED = "d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '$click and $ViewS ' WHEN doc_id % 7 = 0 THEN '$errorx ' ELSE '' END || text AS text FROM documents)"


def _tagged(spark, d):
    docs = fx.table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "$click and $ViewS ").when(F.col("doc_id") % 7 == 0, "$errorx ").otherwise(""), "text").alias("text"))


@query("cashtags", rf"WITH {_TAGGED} SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text), '\$([A-Z]{{1,5}})', 1))), ',') AS tags FROM d")
def cashtags(spark, d):
    return _tagged(spark, d).select("doc_id", F.array_join(F.array_sort(text.cashtags(F.col("text"))), ",").alias("tags"))


_KNOWN = "['CLICK', 'ERROR', 'PURCHASE', 'SIGNUP', 'VIEW']"
_PAIRS = (("der", "CLICK"), ("eau", "VIEW"), ("tion th", "SIGNUP"))


@query("ticker_tags", rf"""WITH {_TAGGED}, t AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_intersect(regexp_extract_all(upper(text), '\$([A-Z]{{1,5}})', 1), {_KNOWN}),
 {', '.join(f"CASE WHEN contains(lower(text), '{k}') THEN ['{t}'] ELSE [] END" for k, t in _PAIRS[:1])}, {', '.join(f"CASE WHEN contains(lower(text), '{k}') THEN ['{t}'] ELSE [] END" for k, t in _PAIRS[1:2])}, {', '.join(f"CASE WHEN contains(lower(text), '{k}') THEN ['{t}'] ELSE [] END" for k, t in _PAIRS[2:])}))) AS l FROM d)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'GENERAL' ELSE array_to_string(l, ',') END AS tickers FROM t""")
def ticker_tags(spark, d):
    pairs = spark.createDataFrame(list(_PAIRS), "keyword string, ticker string")
    out = text.tag_tickers(_tagged(spark, d), "text", pairs, fx.companies(spark, d).filter("is_active").select("ticker"))
    return out.select("doc_id", F.array_join("tickers", ",").alias("tickers"))


def _count(words):
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))"


# up = u + 1, down = n + 1, flat = words - up - down + 3, total = words + 3
_SCORED = rf"""scored AS (SELECT id, ts, social, source, CASE WHEN blank THEN 0.0 ELSE round(CAST((up - down) / total * (1 - (total - up - down) / total) * 0.1 AS DOUBLE), 4) END AS score FROM
 (SELECT id, ts, social, source, trim(coalesce(text, '')) = '' AS blank, CAST({_count(text.POSITIVE)} + 1 AS DOUBLE) AS up, CAST({_count(text.NEGATIVE)} + 1 AS DOUBLE) AS down, CAST(len(list_filter(w, lambda x: x != '')) + 3 AS DOUBLE) AS total
 FROM (SELECT *, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM posts)))"""


def _scored(spark, d):
    return text.score_text(fx.posts(spark, d), "text")


@query("lexicon_sentiment", f"WITH {fx.POSTS}, {_SCORED} SELECT id, score AS sentiment_score FROM scored")
def lexicon(spark, d):
    return _scored(spark, d).select("id", "sentiment_score")


_TICKER = "(['CLICK', 'ERROR', 'PURCHASE', 'SIGNUP', 'VIEW', 'GENERAL'])[id % 6 + 1]"


@query("sentiment_by_ticker", f"""WITH {fx.POSTS}, {_SCORED}, s AS (SELECT *, {_TICKER} AS ticker FROM scored), p AS (SELECT * FROM s WHERE ticker != 'GENERAL')
SELECT p.id, round(coalesce(avg(q.score) FILTER (WHERE q.social = 'bluesky' AND q.ts >= p.ts - INTERVAL 2 HOUR), 0), 5) AS sentiment_bluesky_mean_2hours, round(coalesce(avg(q.score) FILTER (WHERE q.social = 'bluesky' AND q.ts >= p.ts - INTERVAL 1 DAY), 0), 5) AS sentiment_bluesky_mean_1day,
round(coalesce(avg(q.score) FILTER (WHERE q.social = 'news' AND q.ts >= p.ts - INTERVAL 1 DAY), 0), 5) AS sentiment_news_mean_1day, round(coalesce(avg(q.score) FILTER (WHERE q.social = 'news'), 0), 5) AS sentiment_news_mean_3days
FROM p LEFT JOIN p q ON q.ticker = p.ticker AND q.ts <= p.ts AND q.ts >= p.ts - INTERVAL 3 DAY GROUP BY p.id""")
def by_ticker(spark, d):
    s = records.explode_tickers(fx.with_tickers(_scored(spark, d))).filter("ticker != 'GENERAL'")
    horizons = {"sentiment_bluesky_mean_2hours": ("bluesky", 7200), "sentiment_bluesky_mean_1day": ("bluesky", 86400), "sentiment_news_mean_1day": ("news", 86400), "sentiment_news_mean_3days": ("news", 259200)}
    return features.sentiment_features(s, s.select("id", "ticker", "ts"), horizons).select("id", *[F.round(c, 5).alias(c) for c in horizons])


@query("general_sentiment", f"""WITH {fx.POSTS}, {_SCORED}, s AS (SELECT *, {_TICKER} AS ticker FROM scored), p AS (SELECT * FROM s WHERE ticker != 'GENERAL'), g AS (SELECT * FROM s WHERE ticker = 'GENERAL')
SELECT p.id, round(coalesce(avg(q.score) FILTER (WHERE q.ts >= p.ts - INTERVAL 2 HOUR), 0), 5) AS sentiment_general_bluesky_mean_2hours, round(coalesce(avg(q.score), 0), 5) AS sentiment_general_bluesky_mean_1day
FROM p LEFT JOIN g q ON q.social = 'bluesky' AND q.ts <= p.ts AND q.ts >= p.ts - INTERVAL 1 DAY GROUP BY p.id""")
def general(spark, d):
    s = records.explode_tickers(fx.with_tickers(_scored(spark, d)))
    horizons = {"sentiment_general_bluesky_mean_2hours": ("bluesky", 7200), "sentiment_general_bluesky_mean_1day": ("bluesky", 86400)}
    at = s.filter("ticker != 'GENERAL'").select("id", "ticker", "ts")
    return features.sentiment_features(s, at, horizons, general=True).select("id", *[F.round(c, 5).alias(c) for c in horizons])


@query("general_only", f"WITH {fx.POSTS} SELECT id, {_TICKER} = 'GENERAL' AS general FROM posts")
def general_only(spark, d):
    s = fx.with_tickers(fx.posts(spark, d))
    return records.keep_general(s).select("id", F.lit(True).alias("general")).unionByName(records.keep_general(s, False).select("id", F.lit(False).alias("general")))


_FINANCE = ("tion of", "leaux", "gewalt", "ungen", "risk", "stock")


@query("finance_posts", f"SELECT doc_id, {' OR '.join(f'contains(lower(text), {k!r})' for k in _FINANCE)} AS finance FROM documents")
def finance(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", text.has_keyword(F.col("text"), list(_FINANCE)).alias("finance"))


@query("scored_posts", f"WITH {fx.POSTS}, {_SCORED}, {_KEYWORDS}, h AS (SELECT p.id, count(*) AS n FROM posts p JOIN kw ON contains(lower(p.text), keyword) GROUP BY 1) SELECT s.id, s.score AS sentiment_score, h.n AS n_keywords FROM scored s JOIN h ON h.id = s.id")
def scored_posts(spark, d):
    kw = fx.table(spark, d, "benchmark").select("item_id", F.lower("text").alias("keyword"))
    hits = text.keyword_match(fx.posts(spark, d).select("id", "text"), kw).groupBy("id").agg(F.count("*").alias("n_keywords"))
    return _scored(spark, d).join(hits, "id").select("id", "sentiment_score", "n_keywords")


@query("softmax_scores", "WITH l AS (SELECT doc_id, [CAST(length(text) % 7 AS DOUBLE), CAST(doc_id % 5 AS DOUBLE), CAST(doc_id % 3 AS DOUBLE)] AS v FROM documents), e AS (SELECT doc_id, exp(v[1]) AS a, exp(v[2]) AS b, exp(v[3]) AS c FROM l) SELECT doc_id, round(a / (a + b + c), 6) AS p0, round(b / (a + b + c), 6) AS p1, round(c / (a + b + c), 6) AS p2 FROM e")
def softmax(spark, d):
    v = F.array((F.length("text") % 7).cast("double"), (F.col("doc_id") % 5).cast("double"), (F.col("doc_id") % 3).cast("double"))
    out = fx.table(spark, d, "documents").select("doc_id", numbers.softmax(v).alias("p"))
    return out.select("doc_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@query("parse_times", """SELECT doc_id, strftime(make_timestamp((1704067200 + doc_id * 61) * 1000000 + CASE WHEN doc_id % 2 = 0 THEN 123456 ELSE 0 END), '%Y-%m-%dT%H:%M:%S.') || CASE WHEN doc_id % 2 = 0 THEN '123Z' ELSE '000Z' END AS post, 1704067200 + doc_id * 61 AS epoch,
strftime(make_timestamp((1704067200 + doc_id * 61) * 1000000), '%y-%m') AS month FROM documents""")
def parse_times(spark, d):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 61)
    raw = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("doc_id") % 2 == 0, ".123456789").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "+00:00").otherwise("Z"))
    rows = fx.table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    iso = times.parse_ts(F.regexp_replace("raw", r"\.\d+", ""))
    return rows.select("doc_id", times.parse_post_ts("raw", F.lit("1970-01-01").cast("timestamp")).alias("post"), F.unix_seconds(iso).alias("epoch"), times.month_label(iso).alias("month"))


_SCALARS = {
    "k": r"""'DOUBLE' AS kind, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS number, '' AS said FROM events""",
    "value": "'DOUBLE', value, '' FROM events WHERE value IS NOT NULL",
    "user": "'DOUBLE', CAST(user_id AS DOUBLE), '' FROM events WHERE user_id IS NOT NULL",
    "below": "'STRING', NULL, '-' || CAST(user_id AS VARCHAR) FROM events WHERE user_id IS NOT NULL",
    "type": "'STRING', NULL, event_type FROM events WHERE event_type IS NOT NULL",
    "large": "'BOOLEAN', NULL, CAST(value > 100 AS VARCHAR) FROM events WHERE value IS NOT NULL",
}


@query("json_scalars", " UNION ALL ".join(f"SELECT event_id, '{k}' AS field, {v}" for k, v in _SCALARS.items()))
def json_scalars(spark, d):
    """The fields of a JSON record of each event, its own JSON's `k` among them: what each becomes, a number in `number`, a text or a boolean in `said`."""
    user = F.col("user_id").cast("string")
    record = F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), "value", user.alias("user"), F.concat(F.lit("-"), user).alias("below"), F.col("event_type").alias("type"), (F.col("value") > 100).alias("large"))
    held = F.try_parse_json(F.to_json(record))

    def scalars(v):
        return F.array(*[F.struct(F.lit(k).alias("field"), numbers.json_scalar(F.try_variant_get(v, f"$.{k}", "variant")).alias("v")) for k in _SCALARS])

    # A record is written and parsed once, not once for each use of it in a generator.
    fields = F.transform(F.array(held), scalars)[0]
    rows = fx.table(spark, d, "events").select("event_id", F.inline(fields)).filter("v is not null").withColumn("kind", F.schema_of_variant("v"))
    number = F.col("kind") == "DOUBLE"
    return rows.select("event_id", "field", "kind", F.when(number, F.try_variant_get("v", "$", "double")).alias("number"), F.when(number, "").otherwise(F.try_variant_get("v", "$", "string")).alias("said"))


@query("epoch_times", "SELECT event_id, (1704067200 + event_id * 61) * 1000000 AS us FROM events")
def epoch_times(spark, d):
    return fx.table(spark, d, "events").select("event_id", times.micros(times.from_epoch(F.lit(1704067200) + F.col("event_id") * 61)).alias("us"))


@query("bare_ticker_tags", rf"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'an error, a View ' ELSE '' END || text AS text FROM documents),
t AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_intersect(coalesce(regexp_extract_all(upper(text), '\b([A-Z]{{1,5}})\b', 1), []), {_KNOWN}), CASE WHEN doc_id % 5 = 0 THEN ['REQUESTED'] ELSE [] END))) AS l FROM d)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 'GENERAL' ELSE array_to_string(l, ',') END AS tickers FROM t""")
def bare_tags(spark, d):
    """Bare symbols of a headline, with the ticker that was asked for."""
    key = F.col("doc_id")
    docs = fx.table(spark, d, "documents").select("doc_id", F.concat(F.when(key % 3 == 0, "an error, a View ").otherwise(""), "text").alias("text"))
    asked = F.when(key % 5 == 0, F.array(F.lit("REQUESTED"))).otherwise(F.array().cast("array<string>"))
    return text.tag_tickers(docs, "text", [], list(fx.TICKERS), bare=True, extra=asked).select("doc_id", F.array_join("tickers", ",").alias("tickers"))


_BUCKETS = r"list_distinct(list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}]+'), lambda w: w != ''), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER)))"


@query("word_model_scores", f"""WITH t AS (SELECT doc_id, unnest({_BUCKETS}) AS bucket FROM documents), l AS (SELECT doc_id, CAST(toxic AS INTEGER) AS y FROM labels WHERE toxic IS NOT NULL AND doc_id % 5 != 0),
n AS (SELECT CAST(sum(y) AS DOUBLE) AS ones, CAST(count(*) - sum(y) AS DOUBLE) AS zeros FROM l),
c AS (SELECT bucket, (sum(y) + 0.5) / (any_value(ones) + 1) AS p, (count(*) - sum(y) + 0.5) / (any_value(zeros) + 1) AS q, CAST(count(*) + 1 AS DOUBLE) / (any_value(ones + zeros) + 2) AS pool, any_value(1 / ones + 1 / zeros) AS e FROM t JOIN l USING (doc_id), n GROUP BY bucket),
w AS (SELECT bucket, ln(p / q) AS has, ln((1 - p) / (1 - q)) AS lacks FROM c WHERE abs((p - q) / sqrt(pool * (1 - pool) * e)) > 5),
b AS (SELECT ln((ones + 0.5) / (zeros + 0.5)) + coalesce((SELECT sum(lacks) FROM w), 0) AS bias FROM n), s AS (SELECT doc_id, sum(has - lacks) AS s FROM t JOIN w USING (bucket) GROUP BY 1)
SELECT doc_id, round(bias + coalesce(s, 0), 5) AS log_odds FROM documents LEFT JOIN s USING (doc_id), b""")
def word_scores(spark, d):
    """Log odds that a document is toxic, learned from four fifths of the labels."""
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    labelled = docs.join(fx.table(spark, d, "labels").filter("doc_id % 5 != 0").select("doc_id", "toxic"), "doc_id")
    return docs.select("doc_id", F.round(wordmodel.fit_words(labelled, "text", "toxic").scorer()(F.col("text")), 5).alias("log_odds"))

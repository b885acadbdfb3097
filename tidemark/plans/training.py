"""Queries on scaling, sequences, splits, fits and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import micros
from ..operators import features, joins, records, training
from . import fixtures as fx
from .market import _labelled
from .registry import query

_NEAR = "label AS (SELECT f.event_id, f.ticker, f.ts, f.price, f.size, arg_max(t.price, (t.ts, -t.event_id)) AS y1 FROM trades f LEFT JOIN trades t ON f.ticker = t.ticker AND t.ts <= f.ts + INTERVAL 1 MINUTE AND t.ts >= f.ts - INTERVAL 4 MINUTE GROUP BY 1, 2, 3, 4, 5)"


@query("scaler_fit", f"WITH {fx.TRADES} SELECT ticker, min(price) AS min_price, max(price) AS max_price, min(size) AS min_size, max(size) AS max_size FROM trades GROUP BY 1")
def scaler(spark, d):
    return training.fit_scaler(fx.trades(spark, d), ["price", "size"])


@query("scaled_features", f"WITH {fx.TRADES}, s AS (SELECT ticker, min(price) AS a, max(price) AS b FROM trades GROUP BY 1) SELECT event_id, round((price - a) / CASE WHEN a = b THEN 1 ELSE b - a END, 6) AS price, CAST(0.0 AS DOUBLE) AS flat FROM trades JOIN s USING (ticker)")
def scaled(spark, d):
    t = fx.trades(spark, d).withColumn("flat", F.lit(3.0))
    return training.scale(t, training.fit_scaler(t, ["price", "flat"]), ["price", "flat"]).select("event_id", F.round("price", 6).alias("price"), "flat")


@query("split_counts", f"WITH {fx.TRADES} SELECT ticker, count(*) FILTER (WHERE (event_id * 7919) % 100 < 80) AS n_train, count(*) FILTER (WHERE (event_id * 7919) % 100 >= 80) AS n_val FROM trades GROUP BY 1")
def split(spark, d):
    return training.split(fx.trades(spark, d), "event_id").groupBy("ticker").agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_val"))


@query("sequences_offset", f"""WITH {fx.TRADES}, s AS (SELECT event_id, list(price) OVER w AS p, list(coalesce(size, 0)) OVER w AS z FROM trades WINDOW w AS (PARTITION BY ticker, floor(second(ts) / 10) ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT event_id, p[1] AS first_price, p[5] AS last_price, list_sum(z) AS total FROM s WHERE len(p) = 5""")
def offsets(spark, d):
    out = features.offset_sequences(fx.trades(spark, d), ["price", "size"])
    return out.select("event_id", F.col("sequence")[0][0].alias("first_price"), F.col("sequence")[4][0].alias("last_price"), F.aggregate(training.key_feature_sequence(F.col("sequence"), 1), F.lit(0.0), lambda a, b: a + b).alias("total"))


_SEQ = "s AS (SELECT event_id, ticker, ts, price, list(price) OVER w AS p, lead(price) OVER (PARTITION BY ticker ORDER BY ts) AS label, count(*) OVER (PARTITION BY ticker) AS n FROM trades WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"


@query("training_sequences", f"WITH {fx.TRADES}, {_SEQ} SELECT event_id, p[1] AS x0, p[5] AS x4, label FROM s WHERE len(p) = 5 AND label IS NOT NULL AND n >= 6")
def sequences(spark, d):
    out = training.training_sequences(fx.trades(spark, d), ["price", "size"], "price", "ts")
    return out.select("event_id", F.col("sequence")[0][0].alias("x0"), F.col("sequence")[4][0].alias("x4"), "label")


@query("training_frame", f"""WITH {fx.TRADES}, {fx.BARS}, b AS (SELECT symbol AS ticker, ts, open, volume, close, CAST(epoch_us(ts) // 60000000 AS BIGINT) AS minute FROM bars WHERE open IS NOT NULL AND volume IS NOT NULL AND close IS NOT NULL),
m AS (SELECT ticker, min(open) AS lo, max(open) AS ho, min(volume) AS lv, max(volume) AS hv FROM b GROUP BY 1), x AS (SELECT ticker, ts, minute, close, (open - lo) / CASE WHEN ho = lo THEN 1 ELSE ho - lo END AS o, (volume - lv) / CASE WHEN hv = lv THEN 1 ELSE hv - lv END AS v FROM b JOIN m USING (ticker)),
s AS (SELECT ticker, minute, list(o) OVER w AS o, list(v) OVER w AS v, lead(close) OVER (PARTITION BY ticker ORDER BY ts) AS label FROM x WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT ticker, minute, round(o[1] + 1e-9, 6) AS first_open, round(v[5] + 1e-9, 6) AS last_volume, label, (minute * 7919) % 100 < 80 AS is_train FROM s WHERE len(o) = 5 AND label IS NOT NULL""")
def frame_of_bars(spark, d):
    bars = fx.bars(spark, d).withColumnRenamed("symbol", "ticker").withColumn("minute", F.floor(micros("ts") / 60_000_000).cast("long"))
    out = training.training_frame(bars, ["open", "volume"], "close", "ts", "minute")
    return out.select("ticker", "minute", F.round(F.col("sequence")[0][0] + 1e-9, 6).alias("first_open"), F.round(F.col("sequence")[4][1] + 1e-9, 6).alias("last_volume"), "label", "is_train")


@query("key_feature_sequence", f"WITH {fx.TRADES}, {_SEQ} SELECT event_id, array_to_string(list_transform(p, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS keys FROM s WHERE len(p) = 5 AND label IS NOT NULL AND n >= 6")
def key_sequence(spark, d):
    out = training.training_sequences(fx.trades(spark, d), ["size", "price"], "price", "ts")
    return out.select("event_id", F.array_join(F.transform(training.key_feature_sequence(F.col("sequence"), 1), lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("keys"))


_FIT = f"WITH {fx.TRADES}, {_NEAR}, fit AS (SELECT ticker, regr_slope(y1, price) AS slope, regr_intercept(y1, price) AS intercept, count(*) AS n FROM label WHERE (event_id * 7919) % 100 < 80 AND y1 IS NOT NULL GROUP BY 1)"


def _fit(spark, d):
    rows = training.split(_labelled(spark, d), "event_id").filter("y1 is not null")
    return rows, training.fit_forecaster(rows.filter("is_train"), "price", "y1")


@query("fit_key_feature", f"{_FIT} SELECT ticker, round(slope, 5) AS slope, round(intercept, 4) AS intercept, n FROM fit")
def fit(spark, d):
    return _fit(spark, d)[1].select("ticker", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@query("forecast", f"{_FIT} SELECT event_id, round(intercept + slope * price, 4) AS prediction, epoch_us(ts) + 60000000 AS target_us FROM label JOIN fit USING (ticker) WHERE (event_id * 7919) % 100 >= 80 AND y1 IS NOT NULL")
def forecast(spark, d):
    rows, params = _fit(spark, d)
    return training.forecast(rows.filter("not is_train"), params, "price").select("event_id", F.round("prediction", 4).alias("prediction"), micros("target_ts").alias("target_us"))


@query("forecast_error", f"{_FIT} SELECT ticker, round(avg((y1 - intercept - slope * price) ** 2), 3) AS mse, count(*) AS n FROM label JOIN fit USING (ticker) WHERE (event_id * 7919) % 100 >= 80 AND y1 IS NOT NULL GROUP BY 1")
def error(spark, d):
    rows, params = _fit(spark, d)
    return training.forecast_error(training.forecast(rows.filter("not is_train"), params.drop("n"), "price")).select("ticker", F.round("mse", 3).alias("mse"), "n")


# Sums about the means, and the two equations of the weights solved; the intercept bears no penalty.
_RIDGE = """m AS (SELECT ticker, count(*) * var_pop(price) + 1 AS pp, count(*) * var_pop(size) + 1 AS ss, count(*) * covar_pop(price, size) AS ps, count(*) * covar_pop(price, y1) AS py, count(*) * covar_pop(size, y1) AS sy,
 avg(price) AS p, avg(size) AS s, avg(y1) AS y FROM label WHERE (event_id * 7919) % 100 < 80 AND price IS NOT NULL AND size IS NOT NULL AND y1 IS NOT NULL GROUP BY 1),
w AS (SELECT *, (py * ss - sy * ps) / (pp * ss - ps * ps) AS wp, (sy * pp - py * ps) / (pp * ss - ps * ps) AS ws FROM m)"""


@query("ridge_forecast", f"WITH {fx.TRADES}, {_NEAR}, {_RIDGE} SELECT ticker, round(y - wp * p - ws * s, 4) AS intercept, round(wp, 5) AS price_weight, round(ws, 5) AS size_weight FROM w")
def ridge(spark, d):
    rows, _ = _fit(spark, d)
    fitted = training.fit_ridge(rows.filter("is_train"), ["price", "size"], "y1")
    return fitted.select("ticker", *[F.round(F.col("weights")[i], n).alias(c) for i, (c, n) in enumerate([("intercept", 4), ("price_weight", 5), ("size_weight", 5)])])


@query("forecast_vs_actual", f"{_FIT}, p AS (SELECT event_id, ticker, ts + INTERVAL 60 SECOND AS ts, intercept + slope * price AS prediction FROM label JOIN fit USING (ticker)), a AS (SELECT * FROM trades) SELECT p.event_id, round(p.prediction, 4) AS prediction, a.price AS actual FROM p ASOF LEFT JOIN (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id) = 1) a ON p.ticker = a.ticker AND p.ts >= a.ts")
def versus(spark, d):
    _, params = _fit(spark, d)
    made = training.forecast(_labelled(spark, d), params.drop("n"), "price").select("event_id", "ticker", "prediction", "target_ts")
    t = fx.trades(spark, d).select("ticker", F.col("ts").alias("at"), F.col("price").alias("actual"), F.col("event_id").alias("arrival"))
    return joins.asof_join(made, t, "target_ts", "at", ["ticker"], ["actual"], -F.col("arrival")).select("event_id", F.round("prediction", 4).alias("prediction"), "actual")


@query("feature_frame", f"WITH {fx.TRADES} SELECT event_id, CAST(coalesce(price, 0) AS FLOAT) AS price, CAST(coalesce(size, 0) AS FLOAT) AS size FROM trades")
def frame(spark, d):
    t = fx.trades(spark, d).select("event_id", "ticker", "price", "size").na.fill(0.0)
    cols = training.select_features(t, ("ticker",))
    return records.downcast(t.select(*cols)).select(F.col("event_id").cast("long").alias("event_id"), "price", "size")

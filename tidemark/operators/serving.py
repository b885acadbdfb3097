"""What a dashboard reads: reference prices, changes, newest values and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from ..functions.times import ny, seconds_of_day


def daily_reference(trades: DataFrame) -> DataFrame:
    """For each ticker and New York day: the first price from 16:00, else from 09:30, else of the day, and which it is."""
    local = ny("ts")
    at = seconds_of_day(local)
    rows = trades.withColumn("day", F.to_date(local)).withColumn("at", at)

    def first(test):
        return F.min_by(F.when(test, F.col("price")), F.when(test, F.struct("ts", "event_id")))

    close, open_, any_ = F.col("at") >= 16 * 3600, F.col("at") >= 9 * 3600 + 1800, F.lit(True)
    made = rows.groupBy("ticker", "day").agg(first(close).alias("c"), first(open_).alias("o"), first(any_).alias("a"))
    return made.select("ticker", "day", F.coalesce("c", "o", "a").alias("reference"), F.when(F.col("c").isNotNull(), "close").when(F.col("o").isNotNull(), "open").otherwise("first").alias("tier"))


def daily_change(trades: DataFrame) -> DataFrame:
    """The day's last price against its reference: absolute, in percent (null against 0) and as a sign."""
    last = trades.withColumn("day", F.to_date(ny("ts"))).groupBy("ticker", "day").agg(F.max_by("price", F.struct("ts", "event_id")).alias("last_price"))
    gap = F.col("last_price") - F.col("reference")
    return (
        last.join(daily_reference(trades), ["ticker", "day"])
        .withColumn("change", gap)
        .withColumn("change_pct", ratio(gap, "reference") * 100)
        .withColumn("direction", F.when(gap > 0, "up").when(gap < 0, "down").otherwise("flat"))
    )


def anomaly_span(anomalies: DataFrame) -> DataFrame:
    """Anomalies with start and end in order of time and the direction."""
    return anomalies.withColumn("start", F.least("min_timestamp", "max_timestamp")).withColumn("end", F.greatest("min_timestamp", "max_timestamp")).withColumn("direction", F.when(F.col("price_difference") >= 0, "up").otherwise("down"))


def last_anomaly(anomalies: DataFrame) -> DataFrame:
    """The newest anomaly of each ticker."""
    rest = [c for c in anomalies.columns if c != "ticker"]
    return anomalies.groupBy("ticker").agg(F.max_by(F.struct(*rest), F.struct("end", "start")).alias("r")).select("ticker", "r.*")

"""Streaming forms of the operators, on event time. Inputs are streaming DataFrames with a TIMESTAMP column `ts`."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

DELAY = "10 minutes"


def sliding_features(trades: DataFrame, width: str, slide: str = "10 seconds", delay: str = DELAY, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """Mean, deviation and total of each ticker (or of `by`) over [T - width, T) for every T on the slide."""
    return (
        trades.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"), *by)
        .agg(F.avg("price").alias("price_mean"), F.coalesce(F.stddev_pop("price"), F.lit(0.0)).alias("price_std"), F.sum("size").alias("size_tot"), F.count("*").alias("n"))
        .select(*by, F.col("w.end").alias("at"), "price_mean", "price_std", "size_tot", "n")
    )


def partial_sums(trades: DataFrame, step: str = "10 seconds", delay: str = DELAY) -> DataFrame:
    """Sums of each ticker and step, for long horizons: their windows read these, not a copy of every trade for each slide."""
    return (
        trades.withWatermark("ts", delay)
        .groupBy(F.window("ts", step).alias("w"), "ticker")
        .agg(F.count("price").alias("n"), F.sum("price").alias("x"), F.sum(F.col("price") * F.col("price")).alias("xx"), F.sum("size").alias("v"))
        .select("ticker", F.col("w.start").alias("at"), "n", "x", "xx", "v")
    )


def horizon_means(scores: DataFrame, horizon: str, step: str = "10 seconds", delay: str = DELAY) -> DataFrame:
    """Mean sentiment_score of each ticker and social over [T - horizon, T) for every T on the step: sums a step first, and the long windows read those."""
    keys = ["ticker", "social"]
    sums = scores.withWatermark("ts", delay).groupBy(F.window("ts", step).alias("s"), *keys).agg(F.sum("sentiment_score").alias("x"), F.count("*").alias("n"))
    return sums.groupBy(F.window(F.window_time("s"), horizon, step).alias("w"), *keys).agg(F.sum("x").alias("x"), F.sum("n").alias("n")).select(*keys, F.col("w.end").alias("at"), (F.col("x") / F.col("n")).alias("mean"), "n")


def session_switched(trades: DataFrame, width: str, slide: str = "10 seconds", delay: str = DELAY) -> DataFrame:
    """Sliding features of real trades at instants in the session, and of simulated ones at those outside."""
    from ..operators.features import switch_by_session

    return switch_by_session(sliding_features(trades, width, slide, delay, ("ticker", "simulated")).withColumnRenamed("at", "ts")).withColumnRenamed("ts", "at")


def spikes(trades: DataFrame, threshold: float, width: str = "1 minute", delay: str = DELAY) -> DataFrame:
    from ..operators.features import price_spikes

    return price_spikes(trades.withWatermark("ts", delay), threshold, width)


def distinct_records(df: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """The first arrival of each key within the watermark."""
    return df.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def labelled(features: DataFrame, trades: DataFrame, horizon: int = 60, lookback: int = 300, delay: str = DELAY) -> DataFrame:
    """Every feature row with the price of the newest trade in [t + horizon - lookback, t + horizon], null where there is none; the watermark releases a row once that is known.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    from .labels import next_price

    return next_price(features, trades, horizon, lookback, delay)


def with_context(features: DataFrame, context: Callable[[], DataFrame], fields: list[str], sink: Callable[[DataFrame], None], require: bool = True) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch with the newest context at its rows' times, read anew for every batch."""
    from ..operators.joins import merge_context

    return lambda df, batch_id: sink(merge_context(df, context(), fields, require))


def routed(routes: dict[str, tuple[Column, Callable[[DataFrame], None]]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows to the sink of each predicate that holds."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.persist()
        for test, sink in routes.values():
            sink(df.filter(test))
        df.unpersist()

    return write


def buffered(spark: SparkSession, path: str, ready: Callable[[], bool], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: micro-batches are held below `path` until `ready()`, then all go to the sink with the first batch that finds it so, in order of arrival by `_batch`.

    A batch that is run again replaces itself, and what has been replayed is marked, so a restart neither loses nor repeats a batch. After the last batch, `flush_buffer` replays what is still held.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        if not _exists(spark, f"{path}/replayed-by/_SUCCESS") and not ready():
            df.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/held/batch={batch_id}")
            return
        held = _held(spark, path, df.schema, batch_id)
        sink((held.unionByName(df.withColumn("_batch", F.lit(batch_id))) if held is not None else df.withColumn("_batch", F.lit(batch_id))).drop("batch"), batch_id)
        if held is not None:
            spark.range(1).select(F.lit(batch_id).alias("batch_id")).write.mode("overwrite").parquet(f"{path}/replayed-by")

    return write


def flush_buffer(spark: SparkSession, path: str, schema: StructType, ready: Callable[[], bool], sink: Callable[[DataFrame, int], None]) -> bool:
    """What is held when the stream has ended goes to the sink, if it is ready; whether it did."""
    held = _held(spark, path, schema, -1)
    if held is None or not ready():
        return False
    sink(held, -1)
    spark.range(1).select(F.lit(-1).alias("batch_id")).write.mode("overwrite").parquet(f"{path}/replayed-by")
    return True


def _held(spark: SparkSession, path: str, schema: StructType, batch_id: int) -> DataFrame | None:
    """The batches held, unless another batch has replayed them."""
    if not _exists(spark, f"{path}/held"):
        return None
    if _exists(spark, f"{path}/replayed-by/_SUCCESS") and spark.read.parquet(f"{path}/replayed-by").first()[0] != batch_id:
        return None
    wide = StructType([*schema.fields, StructField("_batch", IntegerType())])
    return spark.read.schema(wide).option("basePath", f"{path}/held").parquet(f"{path}/held").select(*wide.names)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _frame(rows: list[tuple], columns: list[str]):
    """Rows for the JVM; text as plain objects."""
    made = pd.DataFrame(rows, columns=columns)
    made[columns[0]] = made[columns[0]].astype(object)
    return made


class GridMeans(StatefulProcessor):
    """A ticker's mean at every grid instant from its first trade on: of the cell before it, carried over quiet cells.

    State is a sum for each open cell and the last mean; an event-time timer for each instant closes cells as the watermark passes. Late rows go.
    A mean is carried for as long as the watermark moves. To let the state of dead tickers go, `idle` seconds after its last trade a ticker can be left to rest:
    its instants are told, over the whole gap, once a trade follows.
    """

    def __init__(self, step: int = 10, idle: int | None = None):
        self.step, self.idle = step, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell long", "x double, n long")
        self.last = handle.getValueState("last", "mean double, upto long, seen long")
        self.told = handle.getValueState("told", "any boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        # Rows come in parts in any order: until an instant has been told, the grid begins at the earliest cell of all.
        late = self.last.get()[1] if self.told.exists() else None
        sums = []
        for part in rows:
            cells = (part["us"] // (self.step * 1_000_000)).astype("int64")
            sums.append(part["price"].groupby(cells).agg(["sum", "count"]))
        if sums:
            made = pd.concat(sums).groupby(level=0).sum()
            # Rows of cells that have been told are late, and go.
            made = made if late is None else made[made.index >= late]
            if not len(made):
                return iter(())
            for cell, total, count in zip(made.index, made["sum"], made["count"]):
                k = (int(cell),)
                x, n = self.cells.getValue(k) if self.cells.containsKey(k) else (0.0, 0)
                self.cells.updateValue(k, (x + float(total), n + int(count)))
            low, high = int(made.index.min()), int(made.index.max())
            if self.last.exists():
                mean, upto, seen = self.last.get()
                self.last.update((mean, upto if late is not None else min(upto, low), max(seen, high)))
            else:
                self.last.update((float("nan"), low, high))
            self._wake()
        return iter(())

    def _awake(self, upto: int, seen: int) -> bool:
        return self.idle is None or (upto - seen) * self.step < self.idle

    def _wake(self) -> None:
        _, upto, _ = self.last.get()
        self.handle.registerTimer((upto + 1) * self.step * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.last.exists():
            return
        mark = timerValues.getCurrentWatermarkInMs() // (self.step * 1000)
        mean, upto, seen = self.last.get()
        before, out = upto, []
        while upto < mark and self._awake(upto, seen):
            k = (upto,)
            if self.cells.containsKey(k):
                x, n = self.cells.getValue(k)
                mean = x / n if n else mean
                self.cells.removeKey(k)
            upto += 1
            out.append((key[0], upto * self.step, mean))
            if len(out) == 50_000:
                yield _frame(out, ["ticker", "at", "mean"])
                out = []
        self.last.update((mean, upto, seen))
        if upto > before:
            self.told.update((True,))
        if self._awake(upto, seen):
            self._wake()
        if out:
            yield _frame(out, ["ticker", "at", "mean"])

    def close(self) -> None:
        pass


def grid_means(trades: DataFrame, step: int = 10, delay: str = DELAY, idle: int | None = None) -> DataFrame:
    """Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    rows = trades.withWatermark("ts", delay).select("ticker", "ts", "price", F.unix_micros("ts").alias("us"))
    return rows.groupBy("ticker").transformWithStateInPandas(GridMeans(step, idle), "ticker string, at long, mean double", "Append", "EventTime")


class Changes(StatefulProcessor):
    """Observations of an alias that differ from the one before, in order of time within a batch; the first counts, and one after none.

    Of several at one time the last arrival that has a value is the observation. A part of the rows is cut down to its times before the next is read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        def newest(some):
            there = some["value"].notna()
            return some.assign(there=there).sort_values(["us", "there", "arrival"], kind="stable").drop_duplicates("us", keep="last").drop(columns="there")

        every = newest(pd.concat([newest(part[["us", "value", "arrival"]]) for part in rows]))
        value = every["value"]
        before = value.shift(1)
        if len(every):
            before.iloc[0] = self.last.get()[0] if self.last.exists() else None
            self.last.update((float(value.iloc[-1]),))
        out = every[before.isna() | (value.notna() & (value != before))]
        for a in range(0, len(out), 50_000):
            some = out.iloc[a : a + 50_000]
            yield pd.DataFrame({"series": pd.Series([key[0]] * len(some), dtype=object), "us": some["us"].to_numpy(), "value": some["value"].to_numpy()})

    def close(self) -> None:
        pass


def macro_changes(macro: DataFrame) -> DataFrame:
    """series, ts, value of the changes; macro: series, ts, value, and event_id, which numbers arrivals, if it has one. Needs the RocksDB state store."""
    arrival = F.coalesce(F.col("event_id").cast("long"), F.lit(-1)) if "event_id" in macro.columns else F.lit(0).cast("long")
    rows = macro.filter("ts is not null").select("series", F.unix_micros("ts").alias("us"), F.col("value").cast("double").alias("value"), arrival.alias("arrival"))
    made = rows.groupBy("series").transformWithStateInPandas(Changes(), "series string, us long, value double", "Update", "None")
    return made.select("series", F.timestamp_micros("us").alias("ts"), "value")


def first_in_minute(df: DataFrame, delay: str = DELAY) -> DataFrame:
    """The first arrival of each ticker and minute."""
    return df.withColumn("minute", F.date_trunc("MINUTE", "ts")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ticker", "minute"])

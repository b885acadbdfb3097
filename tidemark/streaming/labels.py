"""Next-minute labels of a stream: rows and trades meet by ticker and bucket of time, and each row is looked up among the bucket's sorted trades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of event time that a bucket spans, rows that are given at a time, and what stands for a row's missing id and a trade's.
SPAN, CHUNK, NONE, LAST = 6 * 3600, 50_000, -(1 << 63), (1 << 63) - 1
_KINDS = (("us", np.int64), ("id", np.int64), ("price", np.float64), ("row", np.bool_))


class NextPrice(StatefulProcessor):
    """Rows of a ticker and bucket with the price of the newest trade in [t + ahead - lookback, t + ahead] (microseconds), once the watermark has passed t + ahead; of equal times the first arrival.

    State is the bucket's rows that wait and the trades that these, or rows to come, can still ask for: columns of a chunk of rows as bytes, one list element a chunk. An event-time
    timer stands at the next row's release, or, with none, at the end of the last trade's use. Rows of one id and time are given once.
    """

    def __init__(self, ahead: int, lookback: int):
        self.ahead, self.lookback = ahead, lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", ", ".join(f"{n} binary" for n, _ in _KINDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        got = [{n: part[n].to_numpy(dtype=k) for n, k in _KINDS} for part in rows]
        new = {n: np.concatenate([g[n] for g in got]) for n, _ in _KINDS}
        if len(new["us"]):
            self.chunks.appendValue(tuple(new[n].tobytes() for n, _ in _KINDS))
            self._wake(new)
        return iter(())

    def _released(self, us: np.ndarray) -> np.ndarray:
        """The watermark, in milliseconds, from which all trades that rows of these times ask for are there."""
        return -((us + self.ahead) // -1000)

    def _wake(self, held: dict[str, np.ndarray]) -> None:
        rows, trades = held["us"][held["row"]], held["us"][~held["row"]]
        if len(rows):
            self.handle.registerTimer(int(self._released(rows.min())) - 1)
        elif len(trades):
            self.handle.registerTimer(int(trades.max() + self.lookback) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        if not self.chunks.exists():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        some = list(self.chunks.get())
        held = {n: np.concatenate([np.frombuffer(c[i], dtype=k) for c in some]) for i, (n, k) in enumerate(_KINDS)}
        due = held["row"] & (self._released(held["us"]) <= mark)
        if due.any():
            rows = np.unique(np.stack([held["us"][due], held["id"][due]]), axis=1)
            trades = np.flatnonzero(~held["row"])
            trades = trades[np.lexsort((-held["id"][trades], held["us"][trades]))]
            times, prices = held["us"][trades], held["price"][trades]
            at = np.searchsorted(times, rows[0] + self.ahead, side="right") - 1
            near = (at >= 0) & (np.append(times, 0)[at] >= rows[0] + self.ahead - self.lookback)
            y1 = np.where(near, np.append(prices, np.nan)[at], np.nan)
            for a in range(0, len(at), CHUNK):
                us, ids, y = rows[0, a : a + CHUNK], rows[1, a : a + CHUNK], y1[a : a + CHUNK]
                yield pd.DataFrame({"id": ids, "ticker": pd.Series([key[0]] * len(us), dtype=object), "us": us, "y1": y})
        # Rows to come are later than the watermark.
        wanted = np.where(held["row"], ~due, held["us"] >= mark * 1000 + self.ahead - self.lookback)
        self.chunks.clear()
        if wanted.any():
            left = {n: x[wanted] for n, x in held.items()}
            self.chunks.appendValue(tuple(left[n].tobytes() for n, _ in _KINDS))
            self._wake(left)

    def close(self) -> None:
        pass


def next_price(features: DataFrame, trades: DataFrame, horizon: int, lookback: int, delay: str, span: int = SPAN) -> DataFrame:
    """event_id, ticker, ts of every feature row and y1; a trade goes to each bucket whose rows can ask for it, so a hot ticker is many tasks and a row costs the same however many trades are near it.

    Rows without a time are left out; trades without a price or ticker only move the watermark. Needs the RocksDB state store.
    """
    us, micro = F.unix_micros("ts"), 1_000_000

    def bucket(us):
        return F.floor(us / (span * micro))

    f = features.filter("ts is not null").withWatermark("ts", delay).select("ticker", "ts", bucket(us).alias("bucket"), us.alias("us"), F.coalesce(F.col("event_id").cast("long"), F.lit(NONE)).alias("id"), F.lit(0.0).alias("price"), F.lit(True).alias("row"))
    t = trades.filter("ts is not null").withWatermark("ts", delay)
    # Not a filter, which Spark would push below the watermark: that counts trades without a price too.
    asked = F.when(F.col("price").isNotNull() & F.col("ticker").isNotNull(), F.sequence(bucket(us - horizon * micro), bucket(us - (horizon - lookback) * micro)))
    t = t.withColumn("bucket", F.explode(asked))
    t = t.select("ticker", "ts", "bucket", us.alias("us"), F.coalesce(F.col("event_id").cast("long"), F.lit(LAST)).alias("id"), F.col("price").cast("double").alias("price"), F.lit(False).alias("row"))
    made = f.unionByName(t).groupBy("ticker", "bucket").transformWithStateInPandas(NextPrice(horizon * micro, lookback * micro), "id long, ticker string, us long, y1 double", "Append", "EventTime")
    return made.select(F.nullif("id", F.lit(NONE)).alias("event_id"), "ticker", F.timestamp_micros("us").alias("ts"), "y1")

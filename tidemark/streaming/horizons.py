"""Means over several long horizons at a fine step, from one state: sums of cells, as many as the longest horizon has steps, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import DELAY

#: Rows that a timer gives at a time, and steps whose cells are one value of the state.
CHUNK, BLOCK = 50_000, 512


def _summed(rows: np.ndarray) -> np.ndarray:
    """Of rows of end, sum and count one for each end, in order."""
    ends, at = np.unique(rows[:, 0], return_inverse=True)
    return np.column_stack([ends, np.bincount(at, rows[:, 1], len(ends)), np.bincount(at, rows[:, 2], len(ends))])


class HorizonMeans(StatefulProcessor):
    """A key's mean of each source over [T - horizon, T), at grid instants T that the watermark has passed; 0.0 where a horizon is empty.

    A score adds to the sums of its cell and source; map state holds the cells in blocks of BLOCK steps, so a call reads or writes many. An event-time timer stands at the next instant where something changes: a cell ends, or one has left a
    horizon. As it fires, instants up to the watermark are told from the running sums of the cells in order, and blocks whose cells have all left every horizon go, so state is
    at most the longest horizon's cells and one block's. With `every` all instants from the first score on are told, else only those where a horizon's scores change, between which all
    means stand still. Rows of cells that have been told are late, and go.
    """

    def __init__(self, horizons: dict[str, tuple[str, int]], step: int, every: bool):
        self.horizons, self.step, self.every = horizons, step, every
        self.sources = sorted({s for s, _ in horizons.values()})
        self.longest = {s: max(n for t, n in horizons.values() if t == s) for s in self.sources}
        self.span = BLOCK * step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "source string, block long", "body binary")
        self.told = handle.getValueState("told", "upto long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        upto = self.told.get()[0] if self.told.exists() else None
        new: dict[str, list[np.ndarray]] = {s: [] for s in self.sources}
        for part in rows:
            ends = (part["us"] // (self.step * 1_000_000) + 1) * self.step
            some = part["score"].notna() & ends.notna()
            if upto is not None:
                some &= ends > upto
            for source in self.sources:
                own = some & (part["source"] == source)
                if own.any():
                    new[source].append(_summed(np.column_stack([ends[own], part["score"][own], np.ones(own.sum())])))
        for source, parts in new.items():
            cells = _summed(np.concatenate(parts)) if parts else np.empty((0, 3))
            blocks, firsts = np.unique(cells[:, 0] // self.span, return_index=True)
            for block, own in zip(blocks, np.split(cells, firsts[1:])):
                k = (source, int(block))
                if self.cells.containsKey(k):
                    own = _summed(np.concatenate([self._cells(self.cells.getValue(k)), own]))
                self.cells.updateValue(k, (own.tobytes(),))
        self._wake(self._load(upto), upto)
        return iter(())

    @staticmethod
    def _cells(value: tuple) -> np.ndarray:
        return np.frombuffer(value[0], float).reshape(-1, 3)

    def _load(self, upto: int | None) -> dict[str, np.ndarray]:
        """Of each source its cells in order, end, sum and count, without those that have left every horizon."""
        held: dict[str, list[np.ndarray]] = {s: [np.empty((0, 3))] for s in self.sources}
        for (source, _), value in self.cells.iterator():
            held[source].append(self._cells(value))
        made = {}
        for source, blocks in held.items():
            rows = np.concatenate(blocks)
            rows = rows[np.argsort(rows[:, 0])]
            made[source] = rows if upto is None else rows[rows[:, 0] + self.longest[source] > upto]
        return made

    def _changes(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        """Instants at which a cell enters or leaves a horizon."""
        found = [cells[s][:, 0] + d for s, n in self.horizons.values() for d in (0, n)]
        return np.unique(np.concatenate(found)).astype(np.int64)

    def _wake(self, cells: dict[str, np.ndarray], upto: int | None) -> None:
        next_ = self._changes(cells)
        next_ = next_[next_ > upto] if upto is not None else next_
        if self.every and upto is not None:
            next_ = np.array([upto + self.step])
        if len(next_):
            self.handle.registerTimer(int(next_[0]) * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        mark = timerValues.getCurrentWatermarkInMs() // (self.step * 1000) * self.step
        upto = self.told.get()[0] if self.told.exists() else None
        cells = self._load(upto)
        at = self._changes(cells)
        if self.every:
            at = np.arange(at[0] if upto is None and len(at) else (mark if upto is None else upto) + self.step * (upto is not None), mark + 1, self.step)
        at = at[(at <= mark) & ((at > upto) if upto is not None else True)]
        if len(at):
            means = {}
            for name, (source, seconds) in self.horizons.items():
                ends, sums = cells[source][:, 0], np.vstack([np.zeros((1, 2)), np.cumsum(cells[source][:, 1:], axis=0)])
                span = sums[np.searchsorted(ends, at, side="right")] - sums[np.searchsorted(ends, at - seconds, side="right")]
                means[name] = np.where(span[:, 1] > 0, span[:, 0] / np.maximum(span[:, 1], 1), 0.0)
            for a in range(0, len(at), CHUNK):
                made = pd.DataFrame({"ticker": [key[0]] * len(at[a : a + CHUNK]), "at": at[a : a + CHUNK]} | {k: v[a : a + CHUNK] for k, v in means.items()})
                made["ticker"] = made["ticker"].astype(object)
                yield made
            upto = int(at[-1]) if not self.every else int(mark)
            self.told.update((upto,))
            for source, rows in cells.items():
                gone, block = rows[:, 0] + self.longest[source] <= upto, rows[:, 0] // self.span
                for k in np.setdiff1d(block[gone], block[~gone]).tolist():
                    self.cells.removeKey((source, int(k)))
                cells[source] = rows[~gone]
        self._wake(cells, upto)

    def close(self) -> None:
        pass


def horizon_features(scores: DataFrame, horizons: dict[str, tuple[str, int]], step: int = 10, every: bool = True, delay: str = DELAY) -> DataFrame:
    """ticker, at (seconds), and a mean for each horizon {name: (source, seconds)}; scores: ticker, ts, social, sentiment_score. Horizons are whole numbers of steps.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    if any(n % step for _, n in horizons.values()):
        raise ValueError("a horizon is a whole number of steps")
    rows = scores.withWatermark("ts", delay).select("ticker", "ts", F.unix_micros("ts").alias("us"), F.col("social").alias("source"), F.col("sentiment_score").cast("double").alias("score"))
    schema = ", ".join(["ticker string", "at long", *(f"{k} double" for k in horizons)])
    return rows.groupBy("ticker").transformWithStateInPandas(HorizonMeans(horizons, step, every), schema, "Append", "EventTime")

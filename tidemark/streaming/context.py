"""Global context as one record: all macro aliases and the general sentiment, sent on each post and on each macro value that has changed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..schemas import MACRO_ALIASES

#: Rows that are given at a time.
CHUNK = 50_000
#: What a row is: a post, or the place of a macro value's alias, from 1.
POST = 0


class GlobalContext(StatefulProcessor):
    """Takes macro values and general posts in order of time (macro first, then by id) within a batch.

    A post always gives a record, a macro value only if it differs from the last of its alias. State is the last value of each alias, and the posts of the longest horizon.
    Means are over [t - horizon, t] of what has come by then, 0.0 where that is empty; an alias without a value is null. All by columns: a record costs the same however
    many posts its horizons hold.
    """

    def __init__(self, aliases: tuple[str, ...], horizons: dict[str, int]):
        self.aliases, self.horizons = aliases, horizons
        self.longest = max(horizons.values()) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "alias string", "value double")
        self.posts = handle.getMapState("posts", "us long, id long", "score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        parts = [(p["us"].to_numpy(np.int64), p["id"].to_numpy(np.int64), p["what"].to_numpy(np.int16), p["value"].to_numpy(float)) for p in rows]
        us, ids, what, value = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((ids, what == POST, us))
        us, ids, what, value = us[order], ids[order], what[order], value[order]
        last = {k[0]: v[0] for k, v in self.values.iterator()}
        given = what == POST
        for place, alias in enumerate(self.aliases, 1):
            own = np.flatnonzero(what == place)
            if len(own):
                given[own] = value[own] != np.append(last.get(alias, np.nan), value[own[:-1]])
        us, ids, what, value = us[given], ids[given], what[given], value[given]
        carried = {}
        for place, alias in enumerate(self.aliases, 1):
            at = np.maximum.accumulate(np.where(what == place, np.arange(len(what)), -1))
            carried[alias] = np.where(at >= 0, value[at], last.get(alias, np.nan)) if len(at) else value
            if len(at) and at[-1] >= 0:
                self.values.updateValue((alias,), (float(value[at[-1]]),))
        means = self._means(us, ids, what == POST, value)
        for a in range(0, len(us), CHUNK):
            some = slice(a, a + CHUNK)
            made = {"us": us[some], "kind": (what[some] == POST).astype("int32"), "id": ids[some]}
            yield pd.DataFrame(made | {k: v[some] for k, v in carried.items()} | {k: v[some] for k, v in means.items()})

    def _means(self, us: np.ndarray, ids: np.ndarray, post: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
        """The mean of each horizon at each record, over the posts of earlier batches and those of this one up to the record; what the longest horizon has left goes."""
        before = sorted((at, i, x[0]) for (at, i), x in self.posts.iterator())
        old = np.array([r[0] for r in before], np.int64)
        begin = old[-1] - self.longest if len(old) else None
        # Each with the posts' times, their running sums, and how many of them a record sees; sums in more digits, as a span of them is a difference.
        new, come = us[post], np.cumsum(post)
        sides = [(old, _running([r[2] for r in before]), np.searchsorted(old, us, side="right")), (new, _running(value[post]), come)]
        means = {}
        for name, seconds in self.horizons.items():
            first = us - seconds * 1_000_000
            first = first if begin is None else np.maximum(first, begin)
            total, n = np.zeros(len(us), np.longdouble), np.zeros(len(us), np.int64)
            for times, sums, upto in sides:
                low = np.minimum(np.searchsorted(times, first, side="left"), upto)
                total += sums[upto] - sums[low]
                n += upto - low
            means[name] = np.where(n > 0, total / np.maximum(n, 1), 0.0).astype(float)
        if len(new):
            keep = max(int(new[-1]), int(old[-1]) if len(old) else int(new[-1])) - self.longest
            for at, i, x in zip(new.tolist(), ids[post].tolist(), value[post].tolist()):
                if at >= keep:
                    self.posts.updateValue((at, i), (x,))
            for at, i, _ in before:
                if at < keep:
                    self.posts.removeKey((at, i))
        return means

    def close(self) -> None:
        pass


def _running(scores) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.asarray(scores, np.longdouble))])


def global_context(macro: DataFrame, posts: DataFrame, horizons: dict[str, int], aliases: tuple[str, ...] = MACRO_ALIASES) -> DataFrame:
    """us, kind (0 macro, 1 post), id, a column for each alias and each horizon; macro: id, ts, series, value; posts, the general ones: id, ts, sentiment_score.

    There is one context, so one task holds it: it sees macro values and general posts only, never trades, and of each a time, an id and a number. Rows without time, id or value are left out.
    Needs the RocksDB state store.
    """
    place = F.array_position(F.array(*[F.lit(a) for a in aliases]), F.col("series")).cast("smallint")
    a = macro.filter(F.col("series").isin(*aliases)).select(F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us"), place.alias("what"), F.col("value").cast("double").alias("value"))
    b = posts.select(F.col("id").cast("long").alias("id"), F.unix_micros("ts").alias("us"), F.lit(POST).cast("smallint").alias("what"), F.col("sentiment_score").cast("double").alias("value"))
    rows = a.unionByName(b).filter("us is not null and id is not null and value is not null").withColumn("one", F.lit(0))
    schema = ", ".join(["us long, kind int, id long", *(f"{c} double" for c in (*aliases, *horizons))])
    return rows.groupBy("one").transformWithStateInPandas(GlobalContext(aliases, horizons), schema, "Update", "None")

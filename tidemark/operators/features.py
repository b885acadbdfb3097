"""Trailing features, grids, spikes and sequences over trades or bars (ticker, ts, price, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import in_session, iso_year, micros
from .spans import ARRIVALS, DAY, by_day, max_before, with_halo

SECOND = 1_000_000
WINDOWS = {"1min": 60, "5min": 300, "30min": 1800}


def trailing_features(df: DataFrame, windows: dict[str, int] = WINDOWS, price: str = "price", size: str = "size") -> DataFrame:
    """Mean, population deviation and total over [t - w, t], both ends closed, within the ticker's ISO week.

    Time is cut into blocks of w, so a window is the end of one block, from t - w on, and the beginning of the next, up to t. Sums that run forward and backward
    inside each block give both, and they are added: nothing is ever taken away again, so a row costs the same however many others a window holds, and a
    window's figures depend on its own rows alone, of whatever magnitude. NaN prices make NaN of the windows that hold them; null prices count only by size.
    """
    keys = ["ticker", "isoyear", "isoweek"]
    df = df.withColumn("isoyear", iso_year("ts")).withColumn("isoweek", F.weekofyear("ts")).withColumn("us", micros("ts"))
    # All windows share this partitioning: blocks lie inside a ticker's week.
    rows = df.select(*keys, "us", F.struct(*df.columns).alias("row"), F.col(price).cast("double").alias("x"), F.col(size).cast("double").alias("v"), F.struct().alias("made"))
    for name, seconds in windows.items():
        width = seconds * SECOND
        rows = rows.withColumn("block", F.floor(F.col("us") / width))
        within = W.partitionBy(*keys, "block")
        rows = rows.withColumn("before", _moments("x", "v", within.orderBy("us").rangeBetween(W.unboundedPreceding, W.currentRow)))
        # A row asks at t - w, one block earlier, what comes from there on; rows of that same time are in.
        both = rows.withColumn("asks", F.explode(F.array(F.lit(False), F.lit(True))))
        asks = F.col("asks")
        back = both.select(
            *keys, "asks", (F.col("block") - asks.cast("int")).alias("block"), (F.col("us") - F.when(asks, width).otherwise(0)).alias("at"),
            F.when(~asks, F.col("x")).alias("mx"), F.when(~asks, F.col("v")).alias("mv"), F.when(asks, F.struct("us", "row", "x", "v", "made", "before")).alias("own"),
        )
        after = _moments("mx", "mv", within.orderBy(F.desc("at"), "asks").rowsBetween(W.unboundedPreceding, W.currentRow))
        asked = back.withColumn("after", after).filter("asks")
        rows = asked.select(*keys, *[F.col(f"own.{c}").alias(c) for c in ("us", "row", "x", "v")], F.struct("own.made.*", *_joined(F.col("own.before"), F.col("after"), name)).alias("made"))
    return rows.select("row.*", "made.*")


def _moments(x: str, v: str, over) -> Column:
    """Count, sum and sum of squared deviations of x, and total of v."""
    n = F.count(x).over(over)
    return F.struct(n.alias("n"), F.coalesce(F.sum(x).over(over), F.lit(0.0)).alias("x"), F.coalesce(F.var_pop(x).over(over) * n, F.lit(0.0)).alias("m"), F.coalesce(F.sum(v).over(over), F.lit(0.0)).alias("v"))


def _joined(a: Column, b: Column, name: str) -> list[Column]:
    """Features of two parts of a window together."""
    n = a.n + b.n
    apart = a.x / a.n - b.x / b.n
    spread = a.m + b.m + F.when((a.n > 0) & (b.n > 0), apart * apart * (a.n * b.n / n)).otherwise(0.0)
    return [F.when(n > 0, (a.x + b.x) / n).alias(f"price_mean_{name}"), F.when(n > 0, F.sqrt(spread / n)).otherwise(0.0).alias(f"price_std_{name}"), (a.v + b.v).alias(f"size_tot_{name}")]


def grid_features(trades: DataFrame, step: int, windows: dict[str, int], keys: tuple[str, ...] = ("ticker", "simulated"), bucket: int = DAY) -> DataFrame:
    """At each grid instant T from a key's first trade to its last: mean and total over [T - w, T), means carried over empty windows.

    Trades become sums per grid cell first, so a window of many cells reads as many sums, not a copy of every trade for each instant. The grid is cut into
    buckets of `bucket` seconds, each with the cells that its first windows reach back to, so a hot key is many tasks. The mean that an empty window carries is that of the
    last cell with a price, as the last window that was not empty held no other: a bucket takes it from the one row that each earlier bucket of its key has.
    """
    wide, length = max(windows.values()) // step, max(1, bucket // step)
    # A cell's sums are the instant's that ends it, and count from there on.
    instant = F.floor(micros("ts") / (step * SECOND)) + 1
    sums = trades.withColumn("cell", instant).groupBy(*keys, "cell").agg(F.count("price").alias("n"), F.sum("price").alias("x"), F.sum("size").alias("v"))
    mean, priced = F.when(F.col("n") > 0, F.col("x") / F.col("n")), F.when(F.col("n") > 0, F.col("cell"))
    ends = sums.groupBy(*keys, F.floor(F.col("cell") / length).alias("held")).agg(F.max_by(mean, priced).alias("tail"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    whole = W.partitionBy(*keys)
    along = whole.orderBy("held")
    spans = ends.select(
        *keys, "held", F.min("lo").over(whole).alias("lo"), F.max("hi").over(whole).alias("hi"), F.lead("held", 1).over(along).alias("next"),
        F.last("tail", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.last("tail", True).over(along.rowsBetween(W.unboundedPreceding, 0)).alias("after"),
    )
    buckets = spans.withColumn("bucket", F.explode(F.sequence("held", F.coalesce(F.col("next") - 1, F.col("held")))))
    first = F.col("bucket") * length
    grid = buckets.select(
        *keys, "bucket", F.when(F.col("bucket") == F.col("held"), F.col("before")).otherwise(F.col("after")).alias("carried"),
        F.explode(F.sequence(F.greatest(first, "lo"), F.least(first + length - 1, "hi"))).alias("cell"), F.lit(True).alias("asked"),
    )
    reach = F.sequence(F.floor(F.col("cell") / length), F.floor((F.col("cell") + wide - 1) / length))
    both = grid.unionByName(sums.withColumn("bucket", F.explode(reach)), allowMissingColumns=True)
    order = W.partitionBy(*keys, "bucket").orderBy("cell")
    known = F.coalesce(F.last(mean, True).over(order.rangeBetween(W.unboundedPreceding, 0)), F.col("carried"))
    made = []
    for name, seconds in windows.items():
        frame = order.rangeBetween(-(seconds // step) + 1, 0)
        n = F.sum("n").over(frame)
        made += [F.when(n > 0, F.sum("x").over(frame) / n).otherwise(known).alias(f"price_mean_{name}"), F.coalesce(F.sum("v").over(frame), F.lit(0.0)).alias(f"size_tot_{name}")]
    out = both.select(*keys, "cell", "asked", *made).filter("asked")
    return out.select(*keys, F.timestamp_seconds(F.col("cell") * step).alias("ts"), *[f"price_mean_{n}" for n in windows], *[f"size_tot_{n}" for n in windows])


def sentiment_features(scores: DataFrame, at: DataFrame, horizons: dict[str, tuple[str, int]], general: bool = False) -> DataFrame:
    """`at` (ticker, ts) with the mean score over the horizon before each row, by source; empty horizons give 0.

    scores: ticker, ts, social, sentiment_score. With `general`, the scores of GENERAL count for every ticker.
    """
    if general:
        return general_features(scores, at, horizons)
    longest = max(seconds for _, seconds in horizons.values()) * SECOND
    bucket = F.floor(F.col("_us") / longest)
    # A bucket is as long as the longest horizon, so a score counts in its own and in the next one, and no ticker is one task.
    points = at.select("*", F.col("ticker").alias("_who"), micros("ts").alias("_us"), F.lit(None).cast("string").alias("_social"), F.lit(None).cast("double").alias("_score"), F.lit(True).alias("_asks")).withColumn("_bucket", bucket)
    held = scores.filter(F.col("sentiment_score").isNotNull() & F.col("ticker").isNotNull()).select(F.col("ticker").alias("_who"), micros("ts").alias("_us"), F.col("social").alias("_social"), F.col("sentiment_score").cast("double").alias("_score"), F.lit(False).alias("_asks"))
    both = points.unionByName(held.filter("_us is not null").withColumn("_bucket", F.explode(F.array(bucket, bucket + 1))), allowMissingColumns=True)
    columns = at.columns
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in at.schema.fields), *(f"`{k}` double" for k in horizons)])

    def means(rows):
        """A bucket's points with the mean of each horizon: a difference of running sums, in more digits, at two places that are searched for."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        asks = rows.filter(pc.and_(rows["_asks"], pc.is_valid(rows["_us"])))
        own = rows.filter(pc.invert(rows["_asks"]))
        to = asks["_us"].to_numpy()
        made = []
        for social, seconds in horizons.values():
            some = own.filter(pc.equal(own["_social"], social))
            times, score = some["_us"].to_numpy(), some["_score"].to_numpy()
            order = np.argsort(times, kind="stable")
            times, score = times[order], score[order]
            bad = np.isnan(score)
            sums = np.concatenate([[0.0], np.cumsum(np.where(bad, 0.0, score).astype(np.longdouble))])
            odd = np.concatenate([[0], np.cumsum(bad)])
            low, high = np.searchsorted(times, to - seconds * SECOND, side="left"), np.searchsorted(times, to, side="right")
            mean = ((sums[high] - sums[low]) / np.maximum(high - low, 1)).astype(float)
            made.append(pa.array(np.where(odd[high] > odd[low], np.nan, mean)))
        return pa.Table.from_arrays([*[asks[c] for c in columns], *made], names=[*columns, *horizons])

    known = both.groupBy("_who", "_bucket").applyInArrow(means, kinds)
    # Points without a time have no horizon.
    return known.unionByName(at.filter("ts is null").select("*", *[F.lit(0.0).alias(k) for k in horizons]))


def general_features(scores: DataFrame, at: DataFrame, horizons: dict[str, tuple[str, int]], cell: int = 10) -> DataFrame:
    """`at` (any tickers, ts) with the mean score of GENERAL over the horizon before each row, by source; empty horizons give 0. Horizons are whole numbers of cells.

    Scores become sums a time, and those sums a cell of `cell` seconds, with running sums over cells (a day is a task, days are carried). A row meets three facts of its
    cell and of those a horizon before by equality on the cell, a join that splits however many rows a cell has: the sums of the whole cells between, and the two edge cells' own
    times, of which those inside count. A cell's times are at most as many as its clock ticks. Null scores are left out; NaN ones make NaN of the horizons that hold them.
    """
    width = cell * SECOND
    if any(n % cell for _, n in horizons.values()):
        raise ValueError("a horizon is a whole number of cells")
    names = ("n", "x", "bad")
    score = F.col("sentiment_score")
    held = scores.filter((F.col("ticker") == "GENERAL") & score.isNotNull() & F.col("ts").isNotNull() & F.col("social").isin(*{s for s, _ in horizons.values()}))
    times = held.groupBy("social", micros("ts").alias("us")).agg(F.count("*").alias("n"), F.sum(F.when(F.isnan(score), 0.0).otherwise(score)).alias("x"), F.count_if(F.isnan(score)).alias("bad"))
    cells = times.groupBy("social", F.floor(F.col("us") / width).alias("cell")).agg(*[F.sum(c).alias(c) for c in names], F.collect_list(F.struct("us", *names)).alias("ticks"))
    points = at.withColumn("_us", micros("ts")).withColumn("_cell", F.floor(F.col("_us") / width))
    asked = points.select(F.col("_cell").alias("asked")).distinct()
    shifts = F.array(*[F.struct(F.lit(s).alias("social"), F.lit(d // cell).alias("back")) for s, d in sorted({(s, d) for s, n in horizons.values() for d in (0, n)})])
    wanted = asked.select("asked", F.explode(shifts).alias("w")).select("asked", "w.social", "w.back", (F.col("asked") - F.col("w.back")).alias("cell"))
    every = wanted.select("social", "cell").distinct().join(cells, ["social", "cell"], "full").withColumn("day", F.floor(F.col("cell") * cell / 86_400))
    run = W.partitionBy("social", "day").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    days = every.groupBy("social", "day").agg(*[F.sum(c).alias(c) for c in names])
    earlier = W.partitionBy("social").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    opening = days.select("social", "day", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"day_{c}") for c in names])
    upto = every.select("social", "day", "cell", "ticks", *names, *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"run_{c}") for c in names]).join(opening, ["social", "day"])
    sums = upto.select("social", "cell", "ticks", *[F.coalesce(c, F.lit(0)).alias(c) for c in names], *[(F.col(f"day_{c}") + F.col(f"run_{c}")).alias(f"all_{c}") for c in names])
    facts = wanted.join(sums, ["social", "cell"])
    # One row for each asked cell, with the facts of every horizon.
    fact = F.struct("ticks", *names, *[f"all_{c}" for c in names])
    known = facts.groupBy("asked").agg(*[F.any_value(F.when((F.col("social") == s) & (F.col("back") == b // cell), fact), True).alias(f"f_{s}_{b}") for s, b in sorted({(s, d) for s, n in horizons.values() for d in (0, n)})])
    met = points.join(known, F.col("_cell") == F.col("asked"), "left")

    def edge(ticks: Column, inside) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("x"), F.lit(0).cast("long").alias("bad"))
        return F.coalesce(F.aggregate(F.filter(ticks, inside), zero, lambda a, r: F.struct((a.n + r.n).alias("n"), (a.x + r.x).alias("x"), (a.bad + r.bad).alias("bad"))), zero)

    out = []
    for name, (social, seconds) in horizons.items():
        here, there = F.col(f"f_{social}_0"), F.col(f"f_{social}_{seconds}")
        begin = F.col("_us") - seconds * SECOND
        first, last = edge(there.ticks, lambda r: r.us >= begin), edge(here.ticks, lambda r: r.us <= F.col("_us"))
        n, x, bad = (here[f"all_{c}"] - here[c] - there[f"all_{c}"] + first[c] + last[c] for c in names)
        out.append(F.coalesce(F.when(bad > 0, float("nan")).when(n > 0, x / n), F.lit(0.0)).alias(name))
    return met.select(*at.columns, *out)


def switch_by_session(df: DataFrame) -> DataFrame:
    """Rows of (ticker, simulated, ts): those of real trades in the session, those of simulated ones outside, with `is_simulated_prediction`."""
    outside = ~in_session("ts")
    return df.filter(F.col("simulated") == outside).withColumn("is_simulated_prediction", outside)


def price_spikes(df: DataFrame, threshold: float, window: str = "1 minute") -> DataFrame:
    """Windows whose extremes differ by more than the threshold: signed by their order, the earliest time of equal extremes."""
    low, high = F.min(F.struct("price", "ts")), F.max(F.struct(F.col("price"), (-micros("ts")).alias("late")))
    made = df.groupBy("ticker", F.window("ts", window).alias("w")).agg(low.alias("low"), high.alias("high"), F.count("*").alias("n"))
    high_ts = F.timestamp_micros(-F.col("high.late"))
    gap = F.col("high.price") - F.col("low.price")
    return (
        made.filter("n >= 2")
        .select(
            "ticker", F.col("w.start").alias("window_start"), F.lit("price_spike").alias("anomaly_type"), F.col("low.price").alias("min_price"), F.col("high.price").alias("max_price"),
            F.col("low.ts").alias("min_timestamp"), high_ts.alias("max_timestamp"), F.when(high_ts < F.col("low.ts"), -gap).otherwise(gap).alias("price_difference"),
        )
        .filter(F.abs("price_difference") > threshold)
    )


def first_in_minute(df: DataFrame, *tie: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each ticker and minute, and the rest."""
    order = W.partitionBy("ticker", F.date_trunc("MINUTE", "ts")).orderBy("ts", *tie)
    ranked = df.withColumn("_rank", F.row_number().over(order))
    return ranked.filter("_rank = 1").drop("_rank"), ranked.filter("_rank > 1").drop("_rank")


def monotonic(df: DataFrame, order: str, arrivals: int = ARRIVALS, ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows later than every row of their ticker that arrived before; `order` numbers arrivals, of rows with one number those with lesser `ties` came first."""
    seen = max_before(df, ["ticker"], [order, *ties], F.floor(F.col(order) / arrivals), "ts", "_before")
    return seen.filter("_before is null or ts > _before").select(df.columns)


def offset_sequences(df: DataFrame, features: list[str], n: int = 5, step: int = 10) -> DataFrame:
    """The last n rows at the same offset within the minute, as an array of feature arrays; only full ones."""
    held = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = with_halo(df.withColumn("_slot", F.floor(F.second("ts") / step)), ["ticker", "_slot"], ["ts"], by_day(), n - 1)
    order = W.partitionBy("ticker", "_slot", "_bucket").orderBy("ts").rowsBetween(-(n - 1), 0)
    return rows.withColumn("sequence", F.collect_list(held).over(order)).filter(~F.col("_halo") & (F.size("sequence") == n)).select(*df.columns, "sequence")


def latest(df: DataFrame, by: str, order: Column, *cols: str) -> DataFrame:
    """The newest value of each column for each key."""
    return df.groupBy(by).agg(*[F.max_by(c, order).alias(c) for c in cols])

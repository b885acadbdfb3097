"""Row windows of a key cut into buckets of its order, so that a hot key is many tasks: edge rows, counts and running maxima are carried over.

What is carried is a few rows a key and bucket; only those ever meet in one task a key, so their number is bounded by buckets, not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds of event time, and arrivals, that a bucket spans.
DAY, ARRIVALS = 86_400, 1 << 16


def by_day(ts: str = "ts") -> Column:
    return F.floor(F.unix_seconds(ts) / DAY)


def with_halo(df: DataFrame, keys: list[str], order: list[str], bucket: Column, before: int, after: int = 0) -> DataFrame:
    """df with `_bucket` and `_halo`: each bucket of a key also gets the `before` rows before its first and the `after` rows after its last, marked as halo.

    `bucket` does not fall as `order` rises. A window of so many rows over (keys, _bucket) then sees at its own rows what one over the key would.
    """
    rows = df.withColumn("_bucket", bucket)
    made = rows.withColumn("_halo", F.lit(False))
    marks = rows.select(*keys, "_bucket").distinct()
    for n, up in ((before, True), (after, False)):
        if not n:
            continue
        along = [F.asc(c) if up else F.desc(c) for c in order]
        against = [F.desc(c) if up else F.asc(c) for c in order]
        edge = rows.withColumn("_edge", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*against))).filter(F.col("_edge") <= n).drop("_edge")
        both = edge.select(*keys, "_bucket", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("_row"), F.lit(1).alias("_side"))
        both = both.unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
        # Of two rows one at least is an edge row, as each mark is followed by its bucket's.
        places = [F.asc(f"_o{i}") if up else F.desc(f"_o{i}") for i in range(len(order))]
        near = W.partitionBy(*keys).orderBy(F.asc("_bucket") if up else F.desc("_bucket"), "_side", *places).rowsBetween(-2 * n, -1)
        halo = both.withColumn("_near", F.collect_list("_row").over(near)).filter("_side = 0")
        halo = halo.select("_bucket", F.explode(F.slice(F.col("_near"), F.greatest(F.size("_near") - n + 1, F.lit(1)), n)).alias("_row"))
        made = made.unionByName(halo.select("_row.*", "_bucket", F.lit(True).alias("_halo")))
    return made


def numbered(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "n") -> DataFrame:
    """df with each row's number in its key, from 1: the rows of earlier buckets, and the row's number in its own."""
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    own = rows.withColumn(name, F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)).cast("long"))
    return _met(own, first, [*keys, "_bucket"]).withColumn(name, F.col(name) + F.col("_first")).drop("_first", "_bucket")


def max_before(df: DataFrame, keys: list[str], order: list[str], bucket: Column, value: str, name: str) -> DataFrame:
    """df with the greatest `value` of all rows of its key that come before in `order`: of earlier buckets, and of the row's own. Rows that tie in all of `order` come in any order."""
    rows = df.withColumn("_bucket", bucket)
    tops = rows.groupBy(*keys, "_bucket").agg(F.max(value).alias("_top"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = tops.select(*keys, "_bucket", F.max("_top").over(earlier).alias("_carried"))
    own = rows.withColumn(name, F.max(value).over(W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))
    return _met(own, carried, [*keys, "_bucket"]).withColumn(name, F.greatest(name, "_carried")).drop("_carried", "_bucket")


def last_before(df: DataFrame, keys: list[str], order: str, bucket: Column, values: list[str]) -> DataFrame:
    """df with each of the values replaced by the last of it, nulls left out, of the rows of its key that come before in `order`: of the row's bucket, else of earlier ones."""
    rows = df.withColumn("_bucket", bucket)
    ends = rows.groupBy(*keys, "_bucket").agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*keys, "_bucket", *[F.last(v, ignorenulls=True).over(earlier).alias(f"_from_{v}") for v in values])
    before = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumns({v: F.last(v, ignorenulls=True).over(before) for v in values})
    return _met(own, carried, [*keys, "_bucket"]).withColumns({v: F.coalesce(v, f"_from_{v}") for v in values}).drop("_bucket", *[f"_from_{v}" for v in values])


def _met(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what `held` has for their keys, null ones too."""
    a, b = rows.alias("a"), held.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same).select("a.*", *[f"b.{c}" for c in held.columns if c not in keys])

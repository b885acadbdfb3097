"""Validation, routing, deduplication, filters and projections of records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import on_grid


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def filled(df: DataFrame, col: str) -> Column:
    """Not null, and of text not empty, of an array not without elements."""
    kind = df.schema[col].dataType
    there = F.col(col).isNotNull()
    if isinstance(kind, T.StringType):
        there &= F.col(col) != ""
    if isinstance(kind, T.ArrayType):
        there &= F.size(col) > 0
    return there


def require(df: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Rows in which every column is filled, and the rest."""
    good = _all([filled(df, c) for c in cols])
    return df.filter(good), df.filter(~good)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def split_shapes(raw: DataFrame, shapes: dict[str, tuple[str, list[str]]], value: str = "value") -> dict[str, DataFrame]:
    """Records of a mixed topic by shape: name -> (schema, keys that only it has); what fits none is `bad`."""
    seen = raw.withColumn("_keys", F.json_object_keys(F.when(F.try_parse_json(value).isNotNull(), F.col(value))))
    left, out = F.col("_keys").isNotNull(), {}
    for name, (schema, keys) in shapes.items():
        own = left & F.coalesce(_all([F.array_contains("_keys", k) for k in keys]), F.lit(False))
        out[name] = seen.filter(own).select(F.from_json(value, schema, {"mode": "PERMISSIVE"}).alias("r"), "*").select("r.*", *[c for c in raw.columns if c != value])
        left = left & ~own
    out["bad"] = seen.filter(~F.coalesce(F.col("_keys").isNotNull() & reduce(lambda a, b: a | b, [_all([F.array_contains("_keys", k) for k in keys]) for _, keys in shapes.values()]), F.lit(False))).drop("_keys")
    return out


def record_key(df: DataFrame) -> Column:
    """The first of ticker, symbol and series that a record has."""
    return F.coalesce(*[F.col(c) for c in ("ticker", "symbol", "series") if c in df.columns])


def error_record(text: Column, at: Column) -> list[Column]:
    """What a malformed text becomes: ticker ERROR, score 0."""
    return [at.alias("timestamp"), F.array(F.lit("ERROR")).alias("ticker"), F.lit(0.0).alias("sentiment_score"), text.alias("raw")]


def to_record(df: DataFrame) -> Column:
    """The row as JSON; null fields are left out."""
    return F.to_json(F.struct(*df.columns))


def route(df: DataFrame, routes: dict[str, Column]) -> dict[str, DataFrame]:
    return {name: df.filter(test) for name, test in routes.items()}


def union_records(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe(df: DataFrame, keys: list[str], *order: Column, last: bool = False) -> DataFrame:
    """One row for each key: the first in order, or with `last` the last. An aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(df.columns)


def upsert_rows(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, the last write of each key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return dedupe(both, keys, F.col("_new"), F.col(order), last=True).drop("_new")


def keep_tickers(df: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows of known tickers. The dimension has one row a company; Spark broadcasts it while it is below its threshold."""
    return df.join(companies.select("ticker").distinct(), "ticker", "left_semi")


def keep_general(df: DataFrame, keep: bool = True) -> DataFrame:
    general = F.coalesce(F.array_contains("ticker", "GENERAL"), F.lit(False))
    return df.filter(general if keep else ~general)


def explode_tickers(df: DataFrame) -> DataFrame:
    return df.withColumn("ticker", F.explode("ticker"))


def real_only(predictions: DataFrame) -> DataFrame:
    """Predictions that are neither simulated nor null nor zero."""
    return predictions.filter(~F.coalesce("is_simulated_prediction", F.lit(False)) & F.col("prediction").isNotNull() & (F.col("prediction") != 0))


def recent(df: DataFrame, asof: Column, interval: str, *cols: str) -> DataFrame:
    """Rows with any of the times within the interval before `asof`."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) >= asof - F.expr(f"INTERVAL {interval}") for c in cols]))


def aligned(df: DataFrame, step: int = 10) -> DataFrame:
    return df.filter(on_grid("ts", step))


def clean_macro(raw: DataFrame, min_year: int) -> DataFrame:
    """Values that are numbers, of the year or later."""
    return raw.withColumn("value", F.col("value").try_cast("double")).filter(F.col("value").isNotNull() & (F.year("date") >= min_year))


def macro_latest(macro: DataFrame) -> DataFrame:
    return macro.groupBy("series").agg(F.max("date").alias("date"), F.max_by("value", F.struct("date", "value")).alias("value"))


def macro_wide(macro: DataFrame, aliases: list[str]) -> DataFrame:
    return macro.groupBy("date").pivot("series", aliases).agg(F.max("value"))


def macro_changes(macro: DataFrame) -> DataFrame:
    """Observations that differ from the one before in their series; the first counts as a change."""
    before = F.lag("value").over(W.partitionBy("series").orderBy("date"))
    return macro.withColumn("before", before).filter(~F.col("value").eqNullSafe(F.col("before")))


def null_profile(df: DataFrame) -> DataFrame:
    """Rows, rows without any null, and nulls of each column."""
    whole = _all([F.col(c).isNotNull() for c in df.columns])
    return df.agg(F.count("*").alias("n_rows"), F.count_if(whole).alias("n_complete"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns])


def complete_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def incomplete_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows that have a null."""
    return df.filter(~_all([F.col(c).isNotNull() for c in df.columns])).orderBy(*order).limit(k)


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats; integers as the narrowest type that holds their range."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    spans = df.agg(*[x for c in ints for x in (F.min(c), F.max(c))]).first() if ints else []
    kinds = {}
    for c, low, high in zip(ints, spans[::2], spans[1::2]):
        if low is not None:
            kinds[c] = next((k for k, bits in (("byte", 7), ("short", 15), ("int", 31)) if -(1 << bits) <= low and high < 1 << bits), "long")
    floats = {f.name: F.col(f.name).cast("float") for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(floats | {c: F.col(c).cast(k) for c, k in kinds.items()})


def ordered_projection(df: DataFrame, fields: list[tuple[str, object]]) -> DataFrame:
    """The fields in order, each with its default where null or absent."""
    return df.select(*[F.coalesce(F.col(c), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c) for c, d in fields])


def partition_by_ticker(df: DataFrame, n: int = 2) -> DataFrame:
    return df.repartition(n, "ticker")

"""Training frames, scaling, sequences, splits, per-ticker fits and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import minmax
from .spans import by_day, with_halo


def select_features(df: DataFrame, keys: tuple[str, ...] = ("ticker", "timestamp", "y1")) -> list[str]:
    """All columns but key, time and label."""
    return [c for c in df.columns if c not in keys]


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One row a ticker with the least and greatest value of each feature."""
    return df.groupBy("ticker").agg(*[x for c in features for x in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])


def scale(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    out = df.join(params, "ticker")
    return out.withColumns({c: minmax(F.col(c), F.col(f"min_{c}"), F.col(f"max_{c}")) for c in features}).drop(*[f"{k}_{c}" for k in ("min", "max") for c in features])


def training_sequences(df: DataFrame, features: list[str], label: str, order: str, n: int = 5) -> DataFrame:
    """Arrays of n rows' features with the label of the row after, in order of the time `order`; tickers of fewer than n + 1 rows give none."""
    rows = with_halo(df, ["ticker"], [order], by_day(order), n - 1, 1)
    by = W.partitionBy("ticker", "_bucket").orderBy(order)
    held = F.collect_list(F.array(*[F.col(c).cast("double") for c in features])).over(by.rowsBetween(-(n - 1), 0))
    out = rows.withColumn("sequence", held).withColumn("label", F.lead(label, 1).over(by))
    return out.filter(~F.col("_halo") & (F.size("sequence") == n) & F.col("label").isNotNull()).drop("_halo", "_bucket")


def key_feature_sequence(sequence: Column, at: int) -> Column:
    return F.transform(sequence, lambda r: r[at])


def split(df: DataFrame, row_id: str | None = None, train: int = 80) -> DataFrame:
    """df with `is_train`: by an arithmetic hash of the id, or of the whole row; the same however rows are dealt."""
    h = F.pmod(F.col(row_id) * 7919, F.lit(100)) if row_id else F.pmod(F.xxhash64(*df.columns), F.lit(100))
    return df.withColumn("is_train", h < train)


def training_frame(df: DataFrame, features: list[str], label: str, order: str, row_id: str, n: int = 5) -> DataFrame:
    """From feature rows to what a model is trained on, all tickers in one job: complete rows, features scaled by ticker, sequences with the label of the row after, and the split."""
    whole = df.na.drop(subset=[*features, label])
    scaled = scale(whole.withColumn("_label", F.col(label)), fit_scaler(whole, features), features)
    return split(training_sequences(scaled, features, "_label", order, n).drop("_label"), row_id)


def fit_forecaster(df: DataFrame, feature: str, label: str) -> DataFrame:
    """Slope and intercept of the label on the key feature for each ticker; two sums of squares, so no ticker is gathered."""
    return df.groupBy("ticker").agg(F.regr_slope(label, feature).alias("slope"), F.regr_intercept(label, feature).alias("intercept"), F.count("*").alias("n"))


def fit_ridge(df: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> DataFrame:
    """Ridge weights of each ticker. Only the sums of products reach the solving function: one row a ticker."""
    import pandas as pd

    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    sums = [F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]] + [F.sum(a * F.col(label)) for a in cols]
    made = df.na.drop(subset=[*features, label]).groupBy("ticker").agg(F.array(*sums).alias("s"))
    n = len(cols)

    def solve(batches):
        import numpy as np

        for part in batches:
            out = []
            for s in part["s"]:
                a = np.zeros((n, n))
                a[np.triu_indices(n)] = s[: n * (n + 1) // 2]
                a = a + np.triu(a, 1).T + penalty * np.diag([0.0] + [1.0] * (n - 1))
                out.append(np.linalg.solve(a, np.asarray(s[n * (n + 1) // 2 :])).tolist())
            yield pd.DataFrame({"ticker": part["ticker"], "weights": out})

    return made.mapInPandas(solve, "ticker string, weights array<double>")


def forecast(df: DataFrame, params: DataFrame, feature: str) -> DataFrame:
    """prediction for t + 60 s; tickers without parameters go."""
    return df.join(params, "ticker").withColumn("prediction", F.col("intercept") + F.col("slope") * F.col(feature)).withColumn("target_ts", F.col("ts") + F.expr("INTERVAL 60 SECONDS"))


def forecast_error(df: DataFrame, label: str = "y1") -> DataFrame:
    gap = F.col(label) - F.col("prediction")
    return df.groupBy("ticker").agg(F.avg(gap * gap).alias("mse"), F.count("*").alias("n"))

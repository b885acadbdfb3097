"""A linear text classifier on hashed words, fitted by counts alone.

Each word of a text falls into one of 2**16 buckets, once a text. One aggregate counts the texts of either class that have a bucket; a bucket whose shares differ by more than `least` standard
errors gets the log of the ratio of its shares as weight, and that of the shares without it goes to the bias (naive Bayes over the buckets that tell). So a fit
is one pass and one shuffle of counts, combined before it; at most 2**16 weights (half a megabyte) reach the driver and are broadcast to the scorers, whatever the corpus.

Null or blank texts have no bucket: their score is the bias's. Texts without a class are not learned from. Without texts of both classes nothing is told, and every score is the share of the class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a word's MD5 that are its bucket, and the standard errors by which a bucket must tell.
DIGITS, LEAST = 4, 5.0


def buckets(text: Column) -> Column:
    """The different buckets of a text's words (lower-cased runs of letters)."""
    words = F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, DIGITS), 16, 10).cast("int")))


@dataclass(frozen=True)
class WordModel:
    bias: float
    places: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        out = np.zeros(16**DIGITS)
        out[self.places] = self.weights
        return out

    def scorer(self):
        """A function of a text column: the log odds of the class."""
        from pyspark.sql import SparkSession

        held = SparkSession.active().sparkContext.broadcast((self.bias, self.table()))

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bias, weights = held.value
            for part in parts:
                sizes = np.fromiter(map(len, part), np.int64, len(part))
                own = weights[np.concatenate([np.zeros(0, np.int64), *part]).astype(np.int64)]
                yield pd.Series(bias + np.bincount(np.repeat(np.arange(len(part)), sizes), own, len(part)))

        return lambda text: score(buckets(text))


def fit_words(labelled: DataFrame, text: str, label: str, least: float = LEAST) -> WordModel:
    """Fit to rows of a text and a class (0 or 1, null: unknown)."""
    rows = labelled.filter(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("int").alias("y"))
    ones, n = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    zeros = n - ones
    bias = math.log((ones + 0.5) / (zeros + 0.5))
    if not ones or not zeros:
        return WordModel(bias, np.zeros(0, np.int64), np.zeros(0))
    counts = rows.select(F.explode(buckets(F.col("text"))).alias("bucket"), "y").groupBy("bucket").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b, pool = (F.col("a") + 0.5) / (ones + 1), (F.col("b") + 0.5) / (zeros + 1), (F.col("a") + F.col("b") + 1) / (n + 2)
    told = counts.select("bucket", a.alias("p"), b.alias("q"), ((a - b) / F.sqrt(pool * (1 - pool) * (1 / ones + 1 / zeros))).alias("z")).filter(F.abs("z") > least)
    made = told.select("bucket", F.log(F.col("p") / F.col("q")).alias("has"), F.log((1 - F.col("p")) / (1 - F.col("q"))).alias("lacks")).orderBy("bucket").toPandas()  # at most 16**DIGITS rows
    return WordModel(bias + float(made["lacks"].sum()), made["bucket"].to_numpy(np.int64), (made["has"] - made["lacks"]).to_numpy(float))


def word_scorer(positive: WordModel, negative: WordModel):
    """For `score_text`: probabilities of positive, neutral and negative by a softmax over both log odds and 0."""
    up, down = positive.scorer(), negative.scorer()

    def probabilities(text: Column) -> Column:
        raised = F.transform(F.array(F.struct(up(text).alias("u"), down(text).alias("d"))), lambda s: F.struct((s.u - F.greatest(s.u, s.d, F.lit(0.0))).alias("u"), (-F.greatest(s.u, s.d, F.lit(0.0))).alias("m"), (s.d - F.greatest(s.u, s.d, F.lit(0.0))).alias("d")))[0]
        total = F.exp(raised.u) + F.exp(raised.m) + F.exp(raised.d)
        return F.struct((F.exp(raised.u) / total).alias("positive"), (F.exp(raised.m) / total).alias("neutral"), (F.exp(raised.d) / total).alias("negative"))

    return probabilities

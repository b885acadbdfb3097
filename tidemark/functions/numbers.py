"""Column functions on numbers and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(x: Column | str) -> Column:
    """A double, or null where the text is no number."""
    return (F.col(x) if isinstance(x, str) else x).try_cast("double")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Null if either is null or the divisor is 0."""
    return F.try_divide(top, F.nullif(F.col(bottom) if isinstance(bottom, str) else bottom, F.lit(0.0)))


def softmax(logits: Column) -> Column:
    """Probabilities from logits, shifted by the greatest."""
    raised = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def sentiment_score(positive: Column, neutral: Column, negative: Column) -> Column:
    """(positive - negative), damped by what is neutral, within 0.1 of 0."""
    return F.round((positive - negative) * (1 - neutral) * 0.1, 4)


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; a constant feature has divisor 1."""
    return (x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def json_scalar(value: Column) -> Column:
    """A VARIANT's scalar as records keep it: a number or a text that is an unsigned decimal number becomes a double; a boolean, any other text, a list or an object stays; JSON's null stays null."""
    kind = F.schema_of_variant(value)
    said = F.try_variant_get(value, "$", "string")
    number = kind.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$") | ((kind == "STRING") & said.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"))
    return F.when(number, F.try_variant_get(value, "$", "double").cast("variant")).otherwise(value)

"""Keyword automata: slices, long texts, many keywords, odd rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import text


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("chars", [1 << 21, 40, 1])
def test_matches_equal_contains(spark, chars):
    rng = random.Random(7)
    words = ["ab", "ba", "aab", "b", "x y", "é日", "", "never seen", "İx"]
    texts = [(i, "".join(rng.choice("aABbxy é日") for _ in range(rng.randrange(30)))) for i in range(200)] + [(500, None), (501, ""), (0, "AB again"), (502, "İX")]
    t = spark.createDataFrame(texts, "id long, text string")
    k = spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(90, "ab"), (91, None)], "n long, keyword string")
    want = pairs(t.join(k, F.contains(F.lower("text"), F.col("keyword"))), "id", "text", "n")
    if chars > 1:
        assert pairs(text.keyword_match(t, k, chars=chars), "id", "text", "n") == want and len(want) > 300
    else:
        assert len(text.keyword_slices(k, chars)) > 8
    assert text.keyword_match(t.limit(0), k).count() == text.keyword_match(t, k.limit(0)).count() == 0


def test_long_texts_and_many_keywords(spark):
    """One text of a million characters and one hundred thousand keywords without a whole word inside, in seconds."""
    t = spark.createDataFrame([(1, "ab" * 500_000 + "foxglove"), (2, "the word number k777x here")], "id long, text string")
    k = spark.range(100_000).select(F.concat(F.lit("k"), "id", F.lit("x")).alias("keyword")).unionByName(spark.createDataFrame([("foxglove",)], "keyword string"))
    began = time.time()
    assert pairs(text.keyword_match(t, k, chars=1 << 19), "id", "keyword") == [(1, "foxglove"), (2, "k777x")]
    assert time.time() - began < 60


@pytest.mark.parametrize("chars", [1 << 21, 12])
def test_tags_from_a_dimension(spark, chars):
    rows = spark.createDataFrame([(1, "$aapl and metal"), (2, "the ALPHABET soup $zzz"), (3, None), (4, "nothing")], "id long, text string")
    k = spark.createDataFrame([("meta", "META"), ("alphabet", "GOOGL"), ("alphabet", "GOOG"), ("soup", "SOUP")], "keyword string, ticker string")
    known = spark.createDataFrame([("AAPL",), ("F",)], "ticker string")
    out = text.tag_tickers(rows, "text", k, known, key="id", chars=chars)
    assert {r["id"]: r["tickers"] for r in out.collect()} == {1: ["AAPL", "META"], 2: ["GOOG", "GOOGL", "SOUP"], 3: ["GENERAL"], 4: ["GENERAL"]}
    assert "alphabet" not in out._jdf.queryExecution().toString()
    if chars == 12:
        with pytest.raises(ValueError):
            text.tag_tickers(rows, "text", k, known, chars=chars)

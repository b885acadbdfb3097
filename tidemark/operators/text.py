"""Tickers in texts, keyword matching and sentiment."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import sentiment_score

# Words of a small lexicon, the default scorer's.
POSITIVE = ("gain", "growth", "profit", "rise", "the", "und")
NEGATIVE = ("loss", "fall", "risk", "drop", "of", "le")
#: Characters of keywords that one automaton holds (some 100 bytes each at most), and the most rows of keywords that are broadcast.
SLICE_CHARS, BROADCAST = 1 << 21, 100_000


def has_keyword(text: Column, keywords: list[str]) -> Column:
    """Whether the text, lower-cased, contains any of the keywords as a substring."""
    held = F.array(*[F.lit(k) for k in keywords])
    return F.coalesce(F.exists(held, lambda k: F.contains(F.lower(text), k)), F.lit(False))


def keyword_dim(companies: DataFrame, static: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """ticker, keyword: company names and the comma-separated related words, trimmed and lower-cased, of more than one character, with `static` pairs.

    Of a keyword that several companies have, the last by ticker_id counts.
    """
    words = F.explode(F.array_compact(F.concat(F.array("company_name"), F.coalesce(F.split("related_words", ","), F.array().cast("array<string>")))))
    own = companies.select("ticker_id", "ticker", words.alias("word")).select("ticker_id", "ticker", F.lower(F.trim("word")).alias("keyword"))
    if static:
        own = own.unionByName(companies.sparkSession.createDataFrame([(-1, t, k.strip().lower()) for t, k in static], "ticker_id int, ticker string, keyword string"))
    return own.filter(F.length("keyword") > 1).groupBy("keyword").agg(F.max_by("ticker", "ticker_id").alias("ticker"))


class Automaton:
    """Which of some keywords a text contains: one Aho-Corasick walk over the text, whatever the number of keywords."""

    def __init__(self, keywords: Iterable[str]):
        import ahocorasick

        self.machine, self.empty = ahocorasick.Automaton(), False
        for k in keywords:
            if k:
                self.machine.add_word(k, k)
            self.empty |= not k
        self.machine.make_automaton()

    def found(self, text: str) -> list[str]:
        """The keywords in the text as plain substrings, in order; the empty one is in every text."""
        hits = {k for _, k in self.machine.iter(text)} if len(self.machine) else set()
        return sorted(hits | {""} if self.empty else hits)


_held: dict[str, Automaton] = {}


def _automaton(name: str, keywords: Callable[[], Iterable[str]]) -> Automaton:
    """A worker's one automaton; another slice's makes way."""
    if name not in _held:
        _held.clear()
        _held[name] = Automaton(keywords())
    return _held[name]


def keyword_slices(keywords: DataFrame, chars: int = SLICE_CHARS) -> list[DataFrame]:
    """`keywords` in slices by a hash of the keyword, each of about `chars` characters of different keywords."""
    size = keywords.select("keyword").distinct().agg(F.sum(F.length("keyword") + 1)).first()[0] or 0
    n = max(1, -(-size // chars))
    return [keywords.filter(F.col("keyword").isNotNull() & (F.pmod(F.xxhash64("keyword"), F.lit(n)) == k)) for k in range(n)]


def _finder(part: DataFrame) -> Callable[[Column], Column]:
    """The keywords of a slice that are in a lower-cased text, by an automaton in each worker; the slice is broadcast."""
    held = part.sparkSession.sparkContext.broadcast([r[0] for r in part.select("keyword").distinct().collect()])
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = _automaton(name, lambda: held.value)
        for some in texts:
            yield some.map(machine.found, na_action="ignore")

    return find


def keyword_match(texts: DataFrame, keywords: DataFrame, text: str = "text", chars: int = SLICE_CHARS) -> DataFrame:
    """Pairs of a text and a keyword in it, as plain substrings of the lower-cased text: all columns of both.

    A text is read once for each slice of keywords, in time linear in its length and hits; only pairs that match leave the workers. A null text or keyword matches nothing.
    """
    slices = keyword_slices(keywords, chars)
    hits = [texts.withColumn("_found", F.explode(_finder(part)(F.lower(F.col(text))))) for part in slices]
    found = reduce(DataFrame.unionByName, hits)
    # One slice of few rows is a bounded table.
    few = len(slices) == 1 and keywords.limit(BROADCAST + 1).count() <= BROADCAST
    return found.join(F.broadcast(keywords) if few else keywords, F.col("_found") == F.col("keyword")).drop("_found")


def cashtags(text: Column) -> Column:
    """Symbols after a dollar sign, up to five letters of the upper-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\$([A-Z]{1,5})"), F.lit(1)))


def bare_symbols(text: Column) -> Column:
    """Words of one to five letters of the upper-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"\b([A-Z]{1,5})\b"), F.lit(1)))


def tag_tickers(
    df: DataFrame, text: str, keywords: DataFrame | list[tuple[str, str]], known: DataFrame | list[str], bare: bool = False, default: str | None = "GENERAL", extra: Column | None = None, key: str | None = None, chars: int = SLICE_CHARS
) -> DataFrame:
    """df with `tickers`: cashtags (and bare symbols) that are known, tickers of keywords in the text, and `extra`; sorted, `default` if there are none.

    keywords (keyword, ticker) and known tickers (at most five letters each) are dimensions. One slice of keywords is searched for as the texts stream by; for several,
    matches are collected by `key`, which tells rows apart.
    """
    spark = df.sparkSession
    pairs = keywords if isinstance(keywords, DataFrame) else spark.createDataFrame(list(keywords), "keyword string, ticker string")
    tickers = [r[0] for r in known.select("ticker").distinct().collect()] if isinstance(known, DataFrame) else list(known)
    slices = keyword_slices(pairs, chars)
    if len(slices) > 1:
        if key is None:
            raise ValueError("so many keywords need a key that tells rows apart")
        matched = keyword_match(df.select(key, text), pairs, text, chars).groupBy(key).agg(F.collect_set("ticker").alias("_matched"))
        df = df.join(matched, key, "left")
    own: dict[str, list[str]] = {}
    for r in slices[0].select("keyword", "ticker").distinct().collect() if len(slices) == 1 else []:
        own.setdefault(r["keyword"], []).append(r["ticker"])
    held = spark.sparkContext.broadcast((own, frozenset(tickers)))
    name = uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def tags(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        of, listed = held.value
        machine = _automaton(name, lambda: of)
        for texts, symbols in parts:
            yield pd.Series([sorted({x for x in s if x in listed} | {x for k in machine.found(t) for x in of[k]}) for t, s in zip(texts, symbols)], dtype=object)

    symbols = F.array_union(cashtags(F.col(text)), bare_symbols(F.col(text))) if bare else cashtags(F.col(text))
    found = tags(F.coalesce(F.lower(F.col(text)), F.lit("")), F.coalesce(symbols, F.array().cast("array<string>")))
    for more in [F.coalesce("_matched", F.array().cast("array<string>"))] * (len(slices) > 1) + [extra] * (extra is not None):
        found = F.array_union(found, more)
    found = F.array_sort(found)
    return df.withColumn("tickers", F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found) if default else found).drop("_matched")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def lexicon(text: Column) -> Column:
    """Probabilities (struct of positive, neutral, negative) from how many of the words are in the lexicon, each class counted once more."""
    words = F.split(F.lower(text), r"[^\p{L}]+")

    def counts(w: Column) -> Column:
        # Only the first and the last part of a split can be empty.
        empty = (w[0] == "").cast("int") + ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")
        up, down = (F.size(F.filter(w, lambda x: x.isin(*known))) + 1.0 for known in (POSITIVE, NEGATIVE))
        return F.struct(up.alias("up"), down.alias("down"), (F.size(w) - empty + 3.0).alias("total"))

    return _let(_let(words, counts), lambda c: F.struct((c.up / c.total).alias("positive"), ((c.total - c.up - c.down) / c.total).alias("neutral"), (c.down / c.total).alias("negative")))


def model_scorer(logits: Callable) -> Callable[[Column], Column]:
    """A scorer that asks a model: `logits` takes an iterator of pandas Series of texts and yields for each an array of three logits (positive, neutral, negative) a text."""

    def probabilities(parts):
        import numpy as np
        import pandas as pd

        for made in logits(parts):
            raised = np.stack([np.asarray(x, float) for x in made]) if len(made) else np.zeros((0, 3))
            raised = np.exp(raised - raised.max(axis=1, keepdims=True, initial=-np.inf))
            yield pd.DataFrame(raised / raised.sum(axis=1, keepdims=True), columns=["positive", "neutral", "negative"])

    return F.pandas_udf(probabilities, "positive double, neutral double, negative double", F.PandasUDFType.SCALAR_ITER)


def score_text(df: DataFrame, text: str, scorer: Callable[[Column], Column] = lexicon) -> DataFrame:
    """df with sentiment_score; null or blank text scores 0. A scorer gives a struct of three probabilities; `model_scorer` makes one of a model."""
    scored = df.withColumn("_p", scorer(F.col(text)))
    score = sentiment_score(F.col("_p.positive"), F.col("_p.neutral"), F.col("_p.negative"))
    return scored.withColumn("sentiment_score", F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).otherwise(score)).drop("_p")

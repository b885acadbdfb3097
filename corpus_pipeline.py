"""A corpus pipeline: language ID, n-gram Jaccard join, substring dedup, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, neardups, packing, substrings
from tidemark.llm.queries import vocabulary
from tidemark.llm.shared import settle, written


def _restored(rows: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of `docs`, in order, from rows that hold the others in the struct `rest`."""
    held = {"doc_id": F.col("doc_id"), "text": F.col("text").cast("string")} | changed
    return rows.select(*[held.get(f.name, F.col(f"rest.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without one that some labelled text has, go: nothing can tell their language.

    An unknown lang is filled in. Without any labelled text there is nothing to tell by, and all stay.
    """
    settle(spark)
    known = language.references(docs)
    if not known:
        return docs
    said = language.identify(docs, known, language.alphabet(docs)).filter("lang_pred != 'und' and n_known > 0")
    return _restored(said, docs, lang=F.coalesce("rest.lang", "lang_pred"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group the document with the least doc_id stays, with all its different texts. Rows without doc_id stay."""
    settle(spark)
    stay = neardups.near_duplicates(docs).filter("doc_id = class_id").select("doc_id")
    return docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns).unionByName(docs.filter("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 20 that occurs earlier go; other texts stay as they were."""
    settle(spark)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    return _restored(substrings.remove_repeats(docs), docs, text=text, n_chars=F.length(text))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and its offset there."""
    settle(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("substring_dedup", substring_dedup), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express MinHash, suffix automata or packing; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder before the next, but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Sharding by vector bin packing: bytes, words and rows are balanced together.

Rows of equal text form a group. Groups are dealt by a hash of the text into a bounded number of
parcels, whose three sums (bytes + 1, words, rows) Spark computes; a group of over half a shard in any of
them is split by a hash of doc_id. The parcels, largest first, then go to the shard where the dot
product of their vector with the shard's residual capacity is highest, among shards where they fit. Only the parcels' sums (at most
a few times `parcels` rows, whatever the input) reach the driver; every row then looks its parcel up.

Null text has size 1 and equals only null; the empty text also has size 1. Repeated rows each get a
slot of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import word_count, written

PARCELS = 8192
#: A group of over 1 / HOT of a shard is split.
HOT = 2


def place(vectors: np.ndarray, shards: int) -> list[int]:
    """A shard for each vector: highest dot product with the residual capacity, where all components fit, else where the first does; else where most of that is left."""
    demand = vectors / np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    residual = np.ones((shards, vectors.shape[1]))
    chosen = [0] * len(vectors)
    for i in np.argsort(-demand[:, 0], kind="stable"):
        fits = (residual >= demand[i]).all(axis=1)
        if not fits.any():
            fits = residual[:, 0] >= demand[i, 0]
        if fits.any():
            s = int(np.argmax(np.where(fits, residual @ demand[i], -np.inf)))
        else:
            s = int(np.argmax(residual[:, 0]))
        residual[s] -= demand[i]
        chosen[i] = s
    return chosen


def shard_documents(docs: DataFrame, shards: int = 8, parcels: int = PARCELS) -> DataFrame:
    """doc_id, size, n_words, n_rows, text_crc32, parcel, shard, slot; slots run from 0 without gaps in each shard."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        word_count(F.col("text")).cast("long").alias("words"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text"), F.col("text").isNull()).alias("h"),
        F.xxhash64(F.lit(17), F.col("doc_id")).alias("d"),
    ).withColumn("parcel", F.pmod("h", F.lit(parcels)))
    rows = written(rows, "sizes")
    measures = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n")]
    whole = rows.agg(*measures).first()
    names = ("size", "words", "n")
    share = F.greatest(*[F.col(c) / max(whole[c] or 0, 1) for c in names])
    # At most 3 * HOT * shards groups can be so large.
    hot = rows.groupBy("h").agg(*measures).withColumn("share", share).filter(F.col("share") > 1 / (HOT * shards)).select("h", "share").collect()
    pieces = spark.createDataFrame([(r["h"], int(min(parcels, math.ceil(r["share"] * parcels)))) for r in hot], "h long, parts long")
    rows = rows.join(F.broadcast(pieces), "h", "left").withColumn("part", F.coalesce(F.pmod("d", F.col("parts")) + 1, F.lit(0)).cast("long")).drop("parts", "h", "d")
    sums = rows.groupBy("parcel", "part").agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count("*").alias("n")).orderBy("parcel", "part").toPandas()
    chosen = place(sums[["size", "words", "n"]].to_numpy(dtype=float), shards) if len(sums) else []
    filled, placed = [0] * shards, []
    for parcel, part, n, s in zip(sums["parcel"], sums["part"], sums["n"], chosen):
        placed.append((int(parcel), int(part), int(s), filled[s]))
        filled[s] += int(n)
    plan = spark.createDataFrame(placed, "parcel long, part long, shard int, base long")
    order = W.partitionBy("parcel", "part").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.join(F.broadcast(plan), ["parcel", "part"])
        .withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
        .select("doc_id", "size", F.col("words").alias("n_words"), "text_crc32", "parcel", "part", "shard", "slot")
    )

"""N-gram Jaccard join by MinHash banding.

Shingles are runs of five words (a text of fewer is one shingle), hashed to 64 bits. Rows and bands are chosen so that pairs at the
threshold meet in some band with the target recall. Documents of the same words form a class, and only its least doc_id
goes on. Band hashes are shuffled; each bucket ties its members to the least one, and what is tied together is a cluster. Clusters are cut
into blocks of bounded size, and every pair of blocks is verified in a task on the full shingle sets, so a large cluster is many tasks
and no pair becomes a row: a task gives each document's number of links and a spanning forest of them.

Null text, text without a word and rows with null doc_id are alone: class_id is their doc_id, n_links 0. Rows of the same doc_id are taken for one document, whose text is the one that leads a class, of several the least by a hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_bytes, identity, ship, trim, trimmed, written
from .words import mix, sequence_hashes, word_hashes

SHINGLE, THRESHOLD, RECALL, PERMUTATIONS = 5, 0.8, 0.998, 128
BLOCK_ROWS, BLOCK_BYTES, HOT = 256, 4 << 20, 64


def bands_and_rows(threshold: float, recall: float, permutations: int) -> tuple[int, int]:
    """The most rows a band, within the permutations, for which a pair at the threshold still meets with the target recall."""
    for rows in range(permutations, 0, -1):
        bands = permutations // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return next(b for b in range(1, bands + 1) if 1 - (1 - threshold**rows) ** b >= recall), rows
    return permutations, 1


@cache
def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    made = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return made[:n] | np.uint64(1), made[n:]


def signatures(value: np.ndarray, firsts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (texts x bands) of texts whose shingles are value[firsts[i]:firsts[i + 1]], none empty."""
    a, b = _factors(bands * rows)
    low = (value >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(firsts), bands), np.uint64)
    for k in range(bands):
        h = np.full(len(firsts), k + 1, np.uint64)
        for r in range(k * rows, (k + 1) * rows):
            x = low * np.uint32(a[r] & np.uint64(0xFFFFFFFF) | np.uint64(1)) + np.uint32(b[r] & np.uint64(0xFFFFFFFF))
            x ^= x >> np.uint32(15)
            x *= np.uint32(a[r] >> np.uint64(32) | np.uint64(1))
            h = mix(h ^ np.minimum.reduceat(x, firsts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[:, k] = h
    return out


def _verify(sets: list[np.ndarray], split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of similar sets: i < split <= j, or where split is 0 any i < j."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    # A shingle of one set alone adds nothing.
    shared = np.bincount(which)[which] > 1
    ids, which = np.unique(which[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    a = split or n
    both = np.zeros((a, n - split), np.float32)
    for first in range(0, len(ids), 8192):
        i, j = np.searchsorted(which, [first, first + 8192])
        held = np.zeros((n, min(8192, len(ids) - first)), np.float32)
        held[owner[i:j], which[i:j] - first] = 1
        both += held[:a] @ held[split:].T
    union = sizes[:a, None] + sizes[None, split:] - both
    good = both >= threshold * union - 1e-6
    if not split:
        good &= np.triu(np.ones_like(good), 1)
    i, j = np.nonzero(good)
    return i, j + split


def _least_tied(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n items, the least item that links tie it to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if np.array_equal(new, low):
            return low
        low = new


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, class_id (least doc_id of the near-duplicate group), copy_of (least doc_id with the same words), n_copies, n_links (other texts at the threshold or more)."""
    spark = docs.sparkSession
    ship(spark)
    bands, rows = bands_and_rows(threshold, recall, permutations)
    base = identity(docs).select("doc_id", "text", F.xxhash64("text").alias("own"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in trimmed(batches):
            for batch in by_bytes(whole):
                counts, words = word_hashes(batch.column(1).to_pylist(), 2)
                value, doc, _ = sequence_hashes(words[0], counts, SHINGLE, short=True)
                some = np.flatnonzero(counts)
                band = np.zeros((len(counts), bands), np.uint64)
                if len(some):
                    band[some] = signatures(value, np.searchsorted(doc, some), bands, rows)
                firsts = np.cumsum(counts) - counts
                same = []
                for w in words:
                    at = mix(w + np.uint64(0x9E3779B97F4A7C15) * (np.arange(len(w)) - np.repeat(firsts, counts)).astype(np.uint64))
                    sums = np.concatenate([[np.uint64(0)], np.cumsum(at, dtype=np.uint64)])
                    same.append(mix(sums[firsts + counts] - sums[firsts]).view(np.int64))
                flat = pa.array(band.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(same[0]), pa.array(same[1]), batch.column(2), pa.array(counts), pa.array([len(t) for t in batch.column(1).to_pylist()], pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(counts) + 1, bands, dtype=np.int32)), flat)],
                    ["doc_id", "h1", "h2", "own", "n_words", "size", "bands"],
                )

    signed = written(base.mapInArrow(sign, "doc_id long, h1 long, h2 long, own long, n_words long, size long, bands array<long>"), "signatures")
    linked = signed.filter("n_words > 0 and doc_id is not null")
    # Combined before the shuffle, so a class of a third of all rows is a row a task.
    first = F.min_by(F.struct("own", "size", "bands"), F.struct("doc_id", "own"))
    classes = written(linked.groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), first.alias("first")), "classes")
    leaders = classes.groupBy(F.col("copy_of").alias("doc_id")).agg(F.min_by("first", "first.own").alias("first")).select("doc_id", "first.*")
    banded = leaders.select("doc_id", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1")
    ties = banded.join(buckets, ["band", "value"]).filter("doc_id != low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    clusters = components(ties).withColumnRenamed("node", "doc_id").withColumnRenamed("least", "cluster")
    members = written(clusters.join(leaders.select("doc_id", "own", "size"), "doc_id"), "clusters")
    cut = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).cast("int").alias("parts"))
    groups = max(1, math.ceil((members.agg(F.sum("size")).first()[0] or 0) / BLOCK_BYTES))
    dealt = (
        members.join(cut, "cluster")
        .withColumn("mine", F.pmod(F.xxhash64(F.lit(11), "doc_id"), "parts").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "doc_id", "cluster", "mine",
            # Whole clusters share tasks; a cut one has a task for each two of its parts.
            F.when(F.col("parts") == 1, F.pmod(F.xxhash64("cluster"), F.lit(groups))).otherwise(F.col("cluster")).alias("task"),
            F.when(F.col("parts") == 1, -1).otherwise(F.least("mine", "other")).alias("low"), F.greatest("mine", "other").alias("high"),
        )
    )
    # By a shuffle at every size: a broadcast of members would be one for small inputs only.
    texts = base.join(members.select("doc_id", "own").hint("merge"), ["doc_id", "own"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text")

    def verify(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        table = table.sort_by([("cluster", "ascending"), ("mine", "ascending"), ("doc_id", "ascending")])
        doc, cluster, own = (table.column(c).to_numpy() for c in ("doc_id", "cluster", "mine"))
        counts, words = word_hashes(table.column("text").to_pylist())
        value, of, _ = sequence_hashes(words[0], counts, SHINGLE, short=True)
        sets = [np.unique(s) for s in np.split(value, np.searchsorted(of, np.arange(1, len(doc))))]
        out: list[tuple] = []
        cuts = [0, *(np.flatnonzero(np.diff(cluster)) + 1).tolist(), len(doc)]
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            split = int(np.searchsorted(own[a:b], high)) if low not in (-1, high) else 0
            i, j = _verify(sets[a:b], split, threshold)
            n = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
            tied = _least_tied(b - a, i, j)
            out += [(int(doc[a + k]), int(doc[a + tied[k]]), int(n[k])) for k in np.flatnonzero(n)]
        trim()
        return pa.table([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["doc_id", "tied", "n_links"])

    found = written(dealt.join(texts, "doc_id").groupBy("task", "low", "high").applyInArrow(verify, "doc_id long, tied long, n_links long"), "links")
    links = found.groupBy("doc_id").agg(F.sum("n_links").alias("n_links"))
    ends = components(found.select(F.col("doc_id").alias("a"), F.col("tied").alias("b")))
    near = links.join(ends.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(F.col("doc_id").alias("copy_of"), F.coalesce("least", "doc_id").alias("class_id"), "n_links")
    named = classes.select("h1", "h2", "copy_of", "n_copies").join(near, "copy_of", "left")
    keys, kept = ["h1", "h2"], ["class_id", "copy_of", "n_copies", "n_links"]
    told = written(named.select(*keys, F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes-told")
    # Classes of over 1 / HOT of all rows are fewer than HOT and are met by broadcast; rows that are alone meet none.
    common = F.col("n_copies") > signed.count() / HOT
    rows_, hot = linked.select("doc_id", *keys), F.broadcast(told.filter(common))
    copies = rows_.join(hot, keys).unionByName(rows_.join(hot, keys, "left_anti").join(told.filter(~common), keys)).select("doc_id", *kept)
    alone = signed.filter("n_words = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return copies.unionByName(alone)

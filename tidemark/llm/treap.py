"""Ranked lexical search over K2-treaps of the term-document grid.

Terms are the runs of letters and digits of a text (ASCII ones, and all bytes beyond ASCII), A-Z lower-cased, compared as bytes. One pass over the documents keeps of
each its length and its frequencies of the terms that some item has; counts over all of that give the weights. Documents are dealt to shards of
bounded documents and postings. A shard's grid has a row for each asked term, by weight, and a column for each document, by its most
repeated asked term and length, so that neighbours have similar impacts. The grid is a compressed quadtree: a level is a bitmap of the quadrants that hold anything, in Morton order, walked by rank, and
each cell stores the greatest impact inside it. Rows lie 2**SPREAD apart, so a cell over up to as many documents is of one term alone.

An item's rows descend together. A range of documents carries the node of each of its rows, and no document there scores above the sum of their maxima; the most
promising ranges are halved first, up to BATCH of one level at a time, until no range can reach the k-th best score. At a single column the maxima are the impacts, so
scores are exact, in 64-bit integers. Of documents with equal frequencies and length a shard holds the k of least doc_id, as no other can be among the best.
Shards send their k best, which merge exactly; equal scores go by doc_id.

Items go in groups of at most about GROUP_BYTES of terms, which are broadcast; each group is a pass over the documents of its own.

Defined results: null text, or text without a term, is never found and counts nowhere; rows of null doc_id count in the statistics and are never found. Repeated rows are documents of
their own. An item of null id is left out; rows of one item_id ask as one, each term once. An item without a found document gives no row, an empty table none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import bits_for, by_bytes, identity, ship, trim, written

BEST, SHARD_DOCS, LEAST_SHARDS, SHARD_POSTINGS, GROUP_BYTES = 50, 1 << 14, 16, 1 << 21, 8 << 20
SPREAD, BATCH = 8, 256
FOUND = "item_id long, doc_id long, score long"

_TERM = np.ones(256, bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_low : _high + 1] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Terms in each text, and all of them in order."""
    data = np.frombuffer(b"\0".join([*texts, b""]), np.uint8)
    held = _TERM[data]
    edge = np.diff(held.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    ends = np.append(0, np.cumsum(np.flatnonzero(edge == -1) - starts)).astype(np.int32)
    bounds = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    return np.diff(np.searchsorted(starts, bounds)), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[held]])])


def _interleaved(x: np.ndarray) -> np.ndarray:
    """The bits of x, up to 31, at the even places."""
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


class Treap:
    """A compressed quadtree over points (row, column, impact > 0), each place at most once; `maxima[l]` are the cells of level l in Morton order."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray):
        self.height = bits_for(int(max(rows.max(initial=0), columns.max(initial=0))) + 1)
        key = _interleaved(rows) << 1 | _interleaved(columns)
        order = np.argsort(key, kind="stable")
        key, value = key[order], impacts[order].astype(np.int64)
        self.maxima, self.words, self.ranks = [value], [], []
        for _ in range(self.height):
            parent = key >> 2
            new = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])) if len(parent) else np.zeros(0, np.int64)
            number = np.zeros(len(parent), np.int64)
            number[new[1:]] = 1
            place = 4 * np.cumsum(number) + (key & 3)
            bits = np.zeros((4 * len(new) // 64 + 1) * 64, bool)
            bits[place] = True
            words = np.packbits(bits, bitorder="little").view("<u8")
            self.words.append(words)
            self.ranks.append(np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]).astype(np.int32))
            value = np.maximum.reduceat(value, new) if len(new) else value
            self.maxima.append(value)
            key = parent[new]
        for levels in (self.maxima, self.words, self.ranks):
            levels.reverse()

    def children(self, level: int, nodes: np.ndarray, quadrant: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes (-1: none) and maxima of a quadrant (2 * lower half + right half) of nodes of a level (-1: none)."""
        at = 4 * np.maximum(nodes, 0) + quadrant
        word, bit = self.words[level][at >> 6], (at & 63).astype(np.uint64)
        there = (nodes >= 0) & ((word >> bit & np.uint64(1)) > 0)
        below = self.ranks[level][at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
        below = np.where(there, below, -1)
        return below, np.where(there, self.maxima[level + 1][below], 0)


class Best:
    """The k best (score, id), equal scores by id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.least = k, np.zeros(0, np.int64), np.zeros(0, np.int64), 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = max(1, int(self.scores[-1]))


class Shard:
    """A shard's treap and documents."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        """doc, term, tf: postings; weights: of each term; rows of the grid are terms by descending weight."""
        by_weight = np.argsort(-weights, kind="stable")
        self.row = np.empty(len(weights), np.int64)
        self.row[by_weight] = np.arange(len(weights)) << SPREAD
        # The most repeated asked term of each document.
        leader = np.full(len(ids), -1, np.int64)
        top = np.lexsort((self.row[term], -tf, doc))
        first = top[np.flatnonzero(np.append(True, np.diff(doc[top]) != 0))] if len(top) else top
        leader[doc[first]] = self.row[term[first]]
        order = np.lexsort((ids, lengths, leader))
        column = np.empty(len(ids), np.int64)
        column[order] = np.arange(len(ids))
        self.ids = ids[order]
        m = np.array([50 + 50 * n * n_docs // max(n_terms, 1) for n in lengths.tolist()], np.int64)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        some = impact > 0
        self.treap = Treap(self.row[term[some]], column[doc[some]], impact[some])

    def search(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """doc_ids and scores of the k best documents for a set of terms, and how many ranges were halved."""
        treap, rows, best, opened = self.treap, self.row[terms], Best(k), 0
        h = treap.height
        rows = rows[rows < 1 << h]  # others have no posting here
        if not len(rows) or not len(treap.maxima[0]):
            return best.ids, best.scores, 0
        # Of each level the open ranges: bound, column prefix and nodes.
        open_: list[list[np.ndarray] | None] = [None] * (h + 1)
        open_[0] = [np.full(1, len(rows) * treap.maxima[0][0]), np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int64)]
        tops = [-1] * (h + 1)
        tops[0] = int(open_[0][0][0])
        if not h:
            best.add(open_[0][0], self.ids[:1])
            return best.ids, best.scores, 0
        while True:
            level = max(range(h), key=tops.__getitem__)
            if tops[level] < best.least:
                break
            bound, column, nodes = open_[level]
            some = bound >= best.least
            if len(bound) > BATCH:
                cut = np.partition(bound, len(bound) - BATCH)[len(bound) - BATCH]
                take = some & (bound >= cut)
                rest = some & ~take
                open_[level] = [x[rest] for x in (bound, column, nodes)]
                tops[level] = int(open_[level][0].max(initial=-1))
                column, nodes = column[take], nodes[take]
            else:
                open_[level], tops[level] = None, -1
                if not some.all():
                    column, nodes = column[some], nodes[some]
            opened += len(column)
            down = h - level - 1
            lower = 2 * (rows >> down & 1)
            made = []
            for right in (0, 1) if (len(self.ids) - 1) >> down else (0,):
                below, most = treap.children(level, nodes, lower + right)
                total = most.sum(axis=1)
                live = np.flatnonzero(total >= best.least)
                if len(live):
                    made.append([total[live], 2 * column[live] + right, below[live]])
            for bound, column, nodes in made:
                if not down:
                    best.add(bound, self.ids[column])
                    continue
                held = open_[level + 1]
                open_[level + 1] = [bound, column, nodes] if held is None else [np.concatenate(x) for x in zip(held, (bound, column, nodes))]
                tops[level + 1] = max(tops[level + 1], int(bound.max()))
        return best.ids, best.scores, opened


def _items(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms, for items that have any."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole):
                counts, found = tokens(batch.column("text").to_pylist())
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
                yield pa.RecordBatch.from_pandas(pa.table([ids, found], ["item_id", "term"]).to_pandas().drop_duplicates(), schema=pa.schema([("item_id", pa.int64()), ("term", pa.binary())]), preserve_index=False)

    rows = identity(items.select(F.col("item_id").alias("doc_id"), "text")).filter("doc_id is not null").select("doc_id", "text")
    return rows.mapInArrow(split, "item_id long, term binary").distinct().groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))


def top_k(docs: DataFrame, items: DataFrame, k: int = BEST, shard_docs: int = SHARD_DOCS, group_bytes: int = GROUP_BYTES, least_shards: int = LEAST_SHARDS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) for each item (item_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    asked = written(_items(items), "asked")
    n_items, size = asked.agg(F.count("*"), F.sum(F.aggregate("terms", F.lit(16).cast("long"), lambda a, t: a + F.octet_length(t) + 12))).first()
    groups = min(n_items, -(-(size or 0) // group_bytes))
    rows = identity(docs.select("doc_id", "text")).select("doc_id", "text")
    found = spark.createDataFrame([], FOUND)
    for g in range(groups):
        own = asked.filter(F.pmod(F.xxhash64(F.lit(31), "item_id"), F.lit(groups)) == g).collect()  # about group_bytes, or one item
        found = found if not own else found.unionByName(_found(rows, {r["item_id"]: [bytes(t) for t in r["terms"]] for r in own}, k, shard_docs, least_shards, shard_postings))
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _found(rows: DataFrame, items: dict[int, list[bytes]], k: int, shard_docs: int, least_shards: int, shard_postings: int) -> DataFrame:
    """The k best of each shard for each item."""
    spark = rows.sparkSession
    known = sorted({t for terms in items.values() for t in terms})
    number = {t: i for i, t in enumerate(known)}
    held = spark.sparkContext.broadcast((known, [(i, np.array([number[t] for t in terms], np.int32)) for i, terms in sorted(items.items())]))
    small = np.dtype("<u2") if len(known) < 1 << 16 else np.dtype("<u4")

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, place = pa.array(held.value[0], pa.binary()), 0
        for whole in batches:
            for batch in by_bytes(whole):
                counts, found = tokens(batch.column("text").to_pylist())
                at = pc.index_in(found, value_set=values)
                doc = np.repeat(np.arange(len(counts)), counts)
                hit = at.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(doc[hit] * len(values) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
                cuts = np.searchsorted(key, np.arange(len(counts) + 1) * len(values))
                terms, tf = (key % max(len(values), 1)).astype(small), tf.astype("<u4")
                some = np.flatnonzero(counts)
                columns = [batch.column("doc_id").take(pa.array(some)), pa.array(place + some), pa.array(counts[some])]
                columns += [pa.array([x[a:b].tobytes() for a, b in zip(cuts[some], cuts[some + 1])], pa.binary()) for x in (terms, tf)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "n", "terms", "tf"])
                place += len(counts)

    table = written(rows.mapInArrow(forward, "doc_id long, place long, n long, terms binary, tf binary"), "frequencies")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(held.value[0]), np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), small), minlength=len(df))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(len(known), np.int64)
    for r in table.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # asked terms only
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    shards = int(max(least_shards, -(-n_docs // shard_docs), -(-int(df.sum()) // shard_postings)))

    def search(part: pa.Table) -> pa.Table:
        ids, lengths = part.column("doc_id").to_numpy(), part.column("n").to_numpy()
        bags = [part.column(c).to_pylist() for c in ("terms", "tf")]
        alike: dict[tuple, int] = {}
        kept = []
        for i in np.argsort(ids, kind="stable").tolist():
            same = bags[0][i], bags[1][i], int(lengths[i])
            seen = alike[same] = alike.get(same, 0) + 1
            if seen <= k and same[0]:
                kept.append(i)
        term = np.frombuffer(b"".join(bags[0][i] for i in kept), small).astype(np.int64)
        tf = np.frombuffer(b"".join(bags[1][i] for i in kept), "<u4").astype(np.int64)
        doc = np.repeat(np.arange(len(kept)), [len(bags[0][i]) // small.itemsize for i in kept])
        del bags, alike
        shard = Shard(ids[kept], lengths[kept], doc, term, tf, weights, n_docs, n_terms)
        del doc, term, tf
        out = [[], [], []]
        for item, terms in held.value[1]:
            docs_, scores, _ = shard.search(terms, k)
            out[0].append(np.full(len(docs_), item, np.int64))
            out[1].append(docs_)
            out[2].append(scores)
        del shard
        trim()
        return pa.table([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], ["item_id", "doc_id", "score"])

    dealt = table.filter("doc_id is not null").withColumn("shard", F.pmod(F.xxhash64(F.lit(29), "doc_id", "place"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(lambda part: search(part.drop_columns("shard")), FOUND)

"""Language-model scores from a log-frequency Bloom filter.

Tokens are the words of a text with A-Z lower-cased, then one end. Documents are dealt into blocks of bounded size by a
hash of doc_id; each block sends its distinct tokens and bigrams, with training counts (0: of held-out texts only), to hash ranges, which sum
them over all blocks. All n-grams of a training text, those that occur once too, are quantised (level 1 + floor(log_1.5 count)) and put into a
Bloom filter once for each level up to theirs. A range holds the filter of its own n-grams only, sized by their entries, in slices of at most
`max_filter_bytes` that are filled and probed one after another; it answers each block with the counts of its tokens and the levels of its tokens and
bigrams. So no n-gram is left out at any size, and nothing is broadcast or gathered.

A token's probability mixes the add-one unigram probability with the bigram's relative frequency, all counts read
off the filter by probing levels until one is missing. A unigram's count is the middle of its level, and the total is that of all middles. A bigram's is the least of its level, over the
greatest of its history's level, so the relative frequencies of a history's successors sum to at most one, but for what false positives add. The bigram's weight depends on the
history only, HIT if the bigram before it was in the filter, MISS otherwise, so a history's probabilities sum to at most one too. Both weights are set, not fitted.
The exact counts, which the same ranges sum, make the base score alone.

Null text is empty and scores its end alone. Repeated rows count each and are scored each; an empty table gives none; other columns are left out. With no training document, N = V = 0 and every token has base probability 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bits_for, block_count, block_of, bucket_slices, identity, ship, sizes, written
from .words import mix, word_hashes

#: The second bounds a slice of the filter that is in memory at a time, not the filter.
BLOCK_BYTES, MAX_FILTER_BYTES = 6 << 20, 4 << 20
BASE, PROBES, BITS_AN_ENTRY, HIT, MISS = 1.5, 3, 16, 0.9, 0.02
END = np.uint64(0x5DEECE66D1234567)
UNIGRAM, BIGRAM = 0, 1


def level(counts: np.ndarray) -> np.ndarray:
    """The quantised level of counts of 1 or more."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


#: The least, the greatest and the middle of each level's counts.
LEAST = np.array([0.0] + [max(1, np.ceil(BASE**k - 1e-9)) for k in range(100)])
GREATEST = np.array([0.0] + [max(1, np.ceil(BASE ** (k + 1) - 1e-9) - 1) for k in range(100)])
MIDDLE = np.array([0.0] + [(max(1, np.ceil(BASE**k)) + max(1, np.ceil(BASE ** (k + 1)) - 1)) / 2 for k in range(100)])


class Filter:
    """A view of the filter's bytes: 2**buckets slices of `width` bits, an entry's bits all in the slice of its hash range."""

    def __init__(self, data: np.ndarray, width: int, buckets: int):
        self.data, self.width, self.buckets = data, width, buckets

    @staticmethod
    def places(keys: np.ndarray, kind: int, lev: np.ndarray | int, width: int) -> list[np.ndarray]:
        """Bits, within a slice, of entries (key, level)."""
        seed = keys ^ (np.asarray(lev).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xA5A5 * (kind + 1))
        return [mix(seed + np.uint64(0x632BE59BD9B4E019 * (j + 1) % (1 << 64))) % np.uint64(width) for j in range(PROBES)]

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The highest level such that it and all below are in the filter; 0 if there is none."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        base = (keys >> np.uint64(64 - self.buckets) if self.buckets else np.zeros(len(keys), np.uint64)) * np.uint64(self.width)
        for lev in range(1, len(MIDDLE)):
            if not len(alive):
                break
            hit = np.ones(len(alive), bool)
            for p in self.places(keys[alive], kind, lev, self.width):
                at = base[alive] + p
                hit &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[hit]
            out[alive] = lev
        return out


class _Tokens:
    """A block's tokens in order, ends included, and how many each text has."""

    def __init__(self, texts: list[bytes]):
        counts, hashes = word_hashes([t.lower() for t in texts])
        self.counts = counts + 1
        self.ends = np.cumsum(self.counts)
        self.all = np.full(int(self.counts.sum()), END, np.uint64)
        word = np.ones(len(self.all), bool)
        word[self.ends - 1] = False
        self.all[word] = hashes[0]
        self.before = np.concatenate([[END], self.all[:-1]])
        self.keys, self.which = np.unique(self.all, return_inverse=True)
        self.which_before = np.concatenate([self.which[-1:], self.which[:-1]])  # the last token is an end

    def bigrams(self, buckets: int) -> np.ndarray:
        """Hashes of 40 bits beyond those that choose the range."""
        h = mix(self.before * np.uint64(0xD6E8FEB86659FD93) + (self.all ^ (self.all >> np.uint64(31))))
        drop = np.uint64(max(0, 24 - buckets))
        return (h >> drop) << drop


def score_documents(docs: DataFrame, train: Column, block_bytes: int = BLOCK_BYTES, max_filter_bytes: int = MAX_FILTER_BYTES, bits: int = BITS_AN_ENTRY) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score; `train` tells the rows to learn from."""
    spark = docs.sparkSession
    ship(spark)
    blocks = block_count(sizes(docs)[1], block_bytes)
    buckets = bits_for(max(1, blocks // 2))
    flag = identity(docs.withColumn("__train", F.coalesce(train, F.lit(False)))).select("doc_id", "text", F.col("rest.__train").alias("train"))
    rows = flag.withColumn("block", block_of(blocks))

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        tokens = _Tokens(table.column("text").to_pylist())
        learn = np.repeat(table.column("train").combine_chunks().to_numpy(zero_copy_only=False), tokens.counts)
        counts = np.bincount(tokens.which[learn], minlength=len(tokens.keys)).astype("<u4")
        pair, which = np.unique(tokens.bigrams(buckets), return_inverse=True)
        many = np.bincount(which[learn], minlength=len(pair))
        short = ((pair << np.uint64(buckets)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        out = []
        for kind, key, data, n in ((UNIGRAM, tokens.keys, tokens.keys.astype("<u8").view(np.uint8).reshape(-1, 8), counts), (BIGRAM, pair, short, many.astype("<u4"))):
            at = bucket_slices(key, buckets)
            out += [(block, kind, b, np.ascontiguousarray(data[i:j]).tobytes() + n[i:j].tobytes(), j - i, 0) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return _table(out)

    def add(table: pa.Table) -> pa.Table:
        block, data, lengths = (table.column(c).to_pylist() for c in ("block", "data", "n"))
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        wide = 8 if kind == UNIGRAM else 5
        raw = np.frombuffer(b"".join(d[: wide * n] for d, n in zip(data, lengths)), np.uint8).reshape(-1, wide)
        own = np.frombuffer(b"".join(d[wide * n :] for d, n in zip(data, lengths)), "<u4")
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :wide] = raw
        key = key.view("<u8").ravel()
        if kind == BIGRAM:
            key = (key << np.uint64(24)) >> np.uint64(buckets) | (np.uint64(bucket) << np.uint64(64 - buckets) if buckets else np.uint64(0))
        keys, which = np.unique(key, return_inverse=True)
        total = np.bincount(which, weights=own).astype(np.int64)
        told = filtered(keys, total, kind, max_filter_bytes, bits).astype(np.uint8)
        # Kind -1: what the filter tells of all its unigrams, in halves.
        out = [(-1, kind, bucket, b"", int(total.sum()), int((total > 0).sum()))] + [(-1, -1, bucket, b"", int(2 * MIDDLE[told].sum()), int((told > 0).sum()))] * (kind == UNIGRAM)
        lev, each, at = told[which], total[which].astype("<i8"), 0
        for b, n in zip(block, lengths):
            counted = each[at : at + n].tobytes() if kind == UNIGRAM else b""
            out.append((b, kind, bucket, lev[at : at + n].tobytes() + counted, n, 0))
            at += n
        return _table(out)

    said = written(rows.groupBy("block").applyInArrow(ask, _SCHEMA).groupBy("kind", "bucket").applyInArrow(add, _SCHEMA), "counts")
    whole = {r["kind"]: (r["n"], r["v"]) for r in said.filter("block = -1").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n_train, distinct = whole.get(UNIGRAM, (0, 0))
    twice, n_told = whole.get(-1, (0, 0))

    def finish(table: pa.Table, heard: pa.Table) -> pa.Table:
        tokens = _Tokens(table.column("text").to_pylist())
        heard = heard.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        parts: dict[int, list[tuple[bytes, int]]] = {UNIGRAM: [], BIGRAM: []}
        for kind, data, n in zip(*(heard.column(c).to_pylist() for c in ("kind", "data", "n"))):
            parts[kind].append((data, n))
        c = np.frombuffer(b"".join(d[n:] for d, n in parts[UNIGRAM]), "<i8")[tokens.which]
        owner_level, pair_level = (np.frombuffer(b"".join(d[:n] for d, n in parts[kind]), np.uint8) for kind in (UNIGRAM, BIGRAM))
        base = (c + 1.0) / (n_train + distinct + 1)
        pair_level = pair_level[np.unique(tokens.bigrams(buckets), return_inverse=True)[1]]
        hit = pair_level > 0
        near = np.concatenate([[False], hit[:-1]])
        near[np.concatenate([[0], tokens.ends[:-1]])] = False
        single = (MIDDLE[owner_level[tokens.which]] + 1.0) / (twice / 2 + n_told + 1)
        context = GREATEST[owner_level[tokens.which_before]]
        ratio = np.where(context > 0, np.minimum(1.0, LEAST[pair_level] / np.maximum(context, 1)), 0.0)
        weight = np.where(near, HIT, MISS)
        firsts = tokens.ends - tokens.counts
        return pa.table(
            [
                table.column("doc_id"), table.column("train"), pa.array(tokens.counts, pa.int64()),
                pa.array(np.add.reduceat((c > 0).astype(np.int64), firsts)), pa.array(np.full(len(firsts), n_train, np.int64)),
                pa.array(np.add.reduceat(np.log10(base), firsts)), pa.array(np.add.reduceat(np.log10((1 - weight) * single + weight * ratio), firsts)),
            ],
            names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    heard = said.filter("block >= 0")
    out = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(finish, out)


_SCHEMA = "block int, kind int, bucket int, data binary, n long, v long"
_TYPES = (("block", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("n", pa.int64()), ("v", pa.int64()))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_TYPES)], names=[n for n, _ in _TYPES])


def filtered(keys: np.ndarray, counts: np.ndarray, kind: int, most: int, entry: int = BITS_AN_ENTRY) -> np.ndarray:
    """The level of each sorted distinct key that a filter of all keys with a count tells; slices of `most` bytes (one key's at least), each of a range of keys."""
    lev = np.zeros(len(keys), np.int64)
    lev[counts > 0] = level(counts[counts > 0])
    part = np.maximum(np.cumsum(lev) - 1, 0) // max(1, 8 * most // entry)
    firsts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(keys)]
    out = np.zeros(len(keys), np.int64)
    for a, b in zip(firsts, firsts[1:]):
        own, up = keys[a:b], lev[a:b]
        width = max(64, int(up.sum()) * entry + 7 & ~7)
        bits = np.zeros(width, bool)
        for k in range(1, int(up.max(initial=0)) + 1):
            for p in Filter.places(own[up >= k], kind, k, width):
                bits[p.astype(np.int64)] = True
        out[a:b] = Filter(np.packbits(bits, bitorder="little"), width, 0).levels(own, kind)
    return out

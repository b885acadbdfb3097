"""Removal of word windows that occur earlier in the corpus, with a count-min prefilter.

Windows are `width` consecutive words. Documents are dealt into blocks of bounded size by a hash of doc_id.
1. Each block sketches its windows: a window counts for the least hash among its runs of `gram` words, so few
   places stand for many windows and equal windows always count for equal places. Count-min rows are far wider than a
   block, so a partition sketch is sent as its non-zero cells. Sketches are merged by ranges of cells; each block
   hears which of its cells are 2 or more in all. A window is estimated repeated if its cell is so in every row:
   collisions can only add windows, never lose one.
2. Each block sends its estimated-repeated windows once per distinct window (96 bits of hash) with the first place in the
   block, so a window that a third of all rows hold comes at most once from a block. Windows are grouped exactly by hash
   ranges, and each block hears, one bit each, which of its first places is the first in all.
3. Each block drops the words that a window covers which has an earlier place.

Places are ordered by doc_id (null last), rows of one doc_id by text (rows without one first by position and a hash of the text), then by position. Null text has no words. A text shorter than a
window loses nothing, unless rows repeat in long texts: of equal rows the first keeps its words. Other columns pass through.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bits_for, block_count, block_of, bucket_slices, identity, ship, sizes, tidily, written
from .words import sequence_hashes, word_hashes

WIDTH, GRAM, DEPTH, BLOCK_BYTES = 20, 8, 2, 6 << 20
_LAST = np.iinfo(np.int64).max


def _sliding(x: np.ndarray, n: int, op: np.ufunc) -> np.ndarray:
    """op over each run of n values, in about log2(n) steps; for fewer values, none."""
    if len(x) < n:
        return x[:0]
    done = 1
    while done < n:
        step = min(done, n - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A block's rows in the order of places, their doc_ids and texts."""
    table = table.combine_chunks()
    doc = table.column("doc_id").fill_null(_LAST).to_numpy()
    texts = table.column("text").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (doc[i], texts[i]))
    return table.take(pa.array(order, pa.int64())), doc[order], [texts[i] for i in order]


class _Windows:
    """A block's windows: their text (rank in the block), position, two hashes, and the sketch places that stand for them."""

    def __init__(self, texts: list[bytes], width: int, gram: int, exact: bool):
        counts, hashes = word_hashes(texts, 2 if exact else 1)
        self.counts = counts
        ends = np.cumsum(counts)
        n = int(ends[-1]) if len(ends) else 0
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        grams = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        value, of, pos = sequence_hashes(hashes[0], counts, gram, seed=1)
        grams[(ends - counts)[of] + pos] = value
        del value, of, pos
        low = _sliding(grams, width - gram + 1, np.minimum)
        # A window starts where its last word is in the same text.
        self.start = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :]) if n >= width else np.zeros(0, np.int64)
        self.low, self.doc = low[self.start], doc[self.start]
        del low, doc
        # A place stands for some window if its hash is the greatest least value among the windows over it.
        most = np.zeros(n + width, np.uint64)
        most[self.start + width - gram] = self.low
        top = _sliding(most, width - gram + 1, np.maximum)[:n]
        del most
        self.places = grams[(grams == top) & (grams != np.iinfo(np.uint64).max)]
        del grams, top
        if exact:
            self.hash = sequence_hashes(hashes[0], counts, width)[0]
            self.check = (sequence_hashes(hashes[1], counts, width, seed=1)[0] >> np.uint64(32)).astype(np.uint32)


def _cells(hashes: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """For each row of the sketch, the cells of hashes, as the leading bits of a uint64."""
    rows = [hashes, hashes * np.uint64(0x9E3779B97F4A7C15) ^ (hashes >> np.uint64(29))][:depth]
    return [(r >> np.uint64(64 - bits)) << np.uint64(64 - bits) for r in rows]


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text, rest (struct of other columns), n_words, n_removed, kept (words joined by one space)."""
    ship(docs.sparkSession)
    total = sizes(docs)[1]
    blocks = block_count(total, block_bytes)
    buckets = bits_for(max(1, blocks // 2))
    # About 1 place for 40 bytes of text; cells at 8 times that.
    bits = min(60, max(buckets + 4, bits_for(max(1, total // 5))))
    wide = 9 if bits - buckets > 32 else 5
    rows = identity(docs).withColumn("block", block_of(blocks))
    bare = rows.select("block", "doc_id", "text")

    def sketch(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        places = _Windows(_ordered(table)[2], width, gram, False).places
        out = []
        for row, cells in enumerate(_cells(places, depth, bits)):
            cell, n = np.unique(cells, return_counts=True)
            at = bucket_slices(cell, buckets)
            own = ((cell << np.uint64(buckets)) >> np.uint64(64 - bits + buckets)).astype(f"<u{wide - 1}")
            n = np.minimum(n, 2).astype(np.uint8)
            out += [(block, row << 24 | b, own[i:j].tobytes() + n[i:j].tobytes()) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        return _table(out)

    def merge(table: pa.Table) -> pa.Table:
        block, bucket, data = (table.column(c).to_pylist() for c in ("block", "bucket", "data"))
        lengths = [len(d) // wide for d in data]
        cell = np.concatenate([np.frombuffer(d[: n * (wide - 1)], f"<u{wide - 1}") for d, n in zip(data, lengths)])
        n = np.concatenate([np.frombuffer(d[k * (wide - 1) :], np.uint8) for d, k in zip(data, lengths)]).astype(np.int64)
        _, which = np.unique(cell, return_inverse=True)
        many = np.bincount(which, weights=n)[which] >= 2
        return _table(_replies(block, bucket, lengths, many))

    def ask(docs_: pa.Table, heard: pa.Table) -> pa.Table:
        if not docs_.num_rows:
            return _table([])
        block = docs_.column("block")[0].as_py()
        table, doc, texts = _ordered(docs_)
        w = _Windows(texts, width, gram, True)
        chosen = _estimated(w, heard)
        key, check, first = _distinct(w, chosen)
        at = bucket_slices(key, buckets)
        ids, pos = doc[w.doc[first]], (w.start[first] - (np.cumsum(w.counts) - w.counts)[w.doc[first]]).astype("<u4")
        return _table([(block, b, key[i:j].astype("<u8").tobytes() + check[i:j].astype("<u4").tobytes() + ids[i:j].astype("<i8").tobytes() + pos[i:j].tobytes()) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i])

    def _estimated(w: _Windows, heard: pa.Table) -> np.ndarray:
        """The windows whose cells are 2 or more in every row of the merged sketch."""
        good = np.ones(len(w.low), bool)
        said = {b: d for b, d in zip(heard.column("bucket").to_pylist(), heard.column("data").to_pylist())}
        for row, (cells, own) in enumerate(zip(_cells(w.places, depth, bits), _cells(w.low, depth, bits))):
            cell = np.unique(cells)
            at = bucket_slices(cell, buckets)
            many = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(said[row << 24 | b], np.uint8), count=j - i).astype(bool) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]])
            if len(cell):
                good &= many[np.searchsorted(cell, own)]
        return np.flatnonzero(good)

    def _distinct(w: _Windows, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct chosen windows in order of hash, and the first window of each."""
        order = chosen[np.lexsort((chosen, w.check[chosen], w.hash[chosen]))]
        key, check = w.hash[order], w.check[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        return key[new], check[new], order[new]

    def group(table: pa.Table) -> pa.Table:
        block, bucket, data = (table.column(c).to_pylist() for c in ("block", "bucket", "data"))
        lengths = [len(d) // 24 for d in data]
        parts = [[d[a * n : b * n] for d, n in zip(data, lengths)] for a, b in ((0, 8), (8, 12), (12, 20), (20, 24))]
        key, check, doc, pos = (np.frombuffer(b"".join(p), t) for p, t in zip(parts, ("<u8", "<u4", "<i8", "<u4")))
        order = np.lexsort((np.repeat(block, lengths), pos, doc, check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        first = np.zeros(len(order), bool)
        first[order[new]] = True
        return _table(_replies(block, bucket, lengths, first))

    schema = "block int, bucket int, data binary"
    sketches = bare.groupBy("block").applyInArrow(lambda t: tidily(sketch, t), schema)
    merged = written(sketches.groupBy("bucket").applyInArrow(lambda t: tidily(merge, t), schema), "sketch")
    asked = bare.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(lambda a, b: tidily(ask, a, b), schema)
    grouped = written(asked.groupBy("bucket").applyInArrow(lambda t: tidily(group, t), schema), "windows")
    heard = merged.withColumn("kind", F.lit(0)).unionByName(grouped.withColumn("kind", F.lit(1)))
    kind = rows.schema["rest"].dataType.simpleString()

    def finish(docs_: pa.Table, heard: pa.Table) -> pa.Table:
        out_schema = pa.schema([(c, docs_.schema.field(c).type) for c in ("doc_id", "text", "rest")] + [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
        if not docs_.num_rows:
            return out_schema.empty_table()
        table, doc, texts = _ordered(docs_)
        w = _Windows(texts, width, gram, True)
        kinds = heard.column("kind").to_numpy()
        chosen = _estimated(w, heard.filter(pa.array(kinds == 0)))
        key, _, first = _distinct(w, chosen)
        said = {b: d for b, d, k in zip(heard.column("bucket").to_pylist(), heard.column("data").to_pylist(), kinds) if k}
        at = bucket_slices(key, buckets)
        alone = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(said[b], np.uint8), count=j - i).astype(bool) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]])
        gone = np.zeros(len(w.low), bool)
        gone[chosen] = True
        gone[first[alone]] = False
        n = int(w.counts.sum())
        steps = np.bincount(w.start[gone], minlength=n + 1) - np.bincount(w.start[gone] + width, minlength=n + 1)
        keep = np.cumsum(steps)[:n] == 0
        ends = np.cumsum(w.counts)
        kept, removed = [], []
        for text, a, b in zip(texts, ends - w.counts, ends):
            own = keep[a:b]
            gone_here = int(len(own) - own.sum())
            removed.append(gone_here)
            kept.append(b" ".join(compress(text.split(), own.tolist()) if gone_here else text.split()))
        return pa.table([table.column("doc_id"), table.column("text"), table.column("rest"), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=out_schema)

    done = rows.groupBy("block").cogroup(heard.groupBy("block")).applyInArrow(lambda a, b: tidily(finish, a, b), f"doc_id long, text binary, rest {kind}, n_words long, n_removed long, kept binary")
    return done.withColumn("text", F.col("text").cast("string")).withColumn("kept", F.col("kept").cast("string"))


_ROWS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)


def _replies(block: list[int], bucket: list[int], lengths: list[int], bits: np.ndarray) -> list[tuple]:
    """A row of packed bits for each of the rows asked."""
    out, at = [], 0
    for b, k, n in zip(block, bucket, lengths):
        out.append((b, k, np.packbits(bits[at : at + n]).tobytes()))
        at += n
    return out

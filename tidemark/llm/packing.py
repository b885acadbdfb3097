"""Best-fit packing of token sequences by bin completion.

Documents become ids and an end id; a document of over `capacity` ids is cut into full pieces and a rest. How many
pieces have each length (at most `capacity` numbers, whatever the input) goes to the driver, which plans there:
around the largest length left, undominated fillings are enumerated by branch and bound on waste, with the best-fit
filling as the first incumbent, and the best is used as often as the counts allow. Each piece then finds its place by
its rank among the pieces of its length; ranks are counted in salted groups, so no length is one task.

Null text is empty: one piece of the end id alone. Repeated rows are packed each. An empty table gives no piece.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections import namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import by_bytes, identity, only, ship, trimmed, written
from .words import span_hashes

CAPACITY, SALTS, NODES = 2048, 64, 400
_KEPT = 300_000
_SPACE, _SMALL, _STOP = np.zeros((3, 256), bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SMALL[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_STOP[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
Plan = namedtuple("Plan", "rows sequences bound")


class WordIds:
    """Ids of texts, span by span.

    The tokenizer's pre-tokens never span ASCII white space, nor a small ASCII letter and ASCII punctuation after it, so
    what lies between such places encodes alone. Equal spans of some texts are found by a hash, checked by a second one, and a task keeps the
    ids of spans that it has seen. ASCII capitals are folded first, as the tokenizer's normaliser would.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        # A special token's own string is told by its case; texts that may hold one go through the library whole.
        special = [b"<|" in t for t in texts]
        folded = [b"" if s else t.lower() for t, s in zip(texts, special)]
        whole = b" ".join(folded) + b" "
        buf = np.frombuffer(whole, np.uint8)
        before = np.concatenate([[32], buf[:-1]])
        gap = _SPACE[buf]
        new = _SPACE[before] | (_STOP[buf] & _SMALL[before])
        starts = np.flatnonzero(~gap & new)
        ends = np.flatnonzero(~_SPACE[before] & (gap | new))
        one, two = span_hashes(whole + b"        ", starts, ends, 2)
        _, first, which = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two, two[first][which]):  # two spans of one hash
            return [self.whole(t.decode()) for t in texts]
        spans = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        if len(self.known) > _KEPT:
            self.known.clear()
        ids = list(map(self.known.get, spans))
        if None in ids:
            self.learn([s for s, i in zip(spans, ids) if i is None])
            ids = list(map(self.known.__getitem__, spans))
        flat = np.frombuffer(b"".join(ids), "<u4")
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        origin = np.cumsum(lengths) - lengths
        each = lengths[which]
        after = np.cumsum(each)
        data = flat[np.repeat(origin[which] - (after - each), each) + np.arange(after[-1] if len(after) else 0)].tobytes()
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in folded], out=bounds[1:])
        cuts = (4 * np.concatenate([[0], after])[np.searchsorted(starts, bounds)]).tolist()
        return [self.whole(t.decode()) if s else data[a:b] for t, s, a, b in zip(texts, special, cuts, cuts[1:])]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, spans: list[bytes]) -> None:
        texts = [s.decode() for s in spans]
        # Spans of letters alone are one pre-token each, so in a text of many of them each ends where a token ends a word.
        small = [(s, t) for s, t in zip(spans, texts) if t.isascii() and t.isalpha()]
        other = [(s, t) for s, t in zip(spans, texts) if not t.isascii() and t.isalpha()]
        # The normaliser leaves small ASCII letters as they are, so these go without it.
        for part, normalizer in ((small, None), (other, self.normalizer)):
            self.tokenizer.normalizer = normalizer
            for at in range(0, len(part), 1024):
                some = part[at : at + 1024]
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join([t for _, t in some])], add_special_tokens=False)[0].ids, "<u4")
                data = ids.tobytes()
                cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
                if len(cuts) != len(some) + 1:  # a letter that folds to one and a mark
                    self.known.update((s, self.whole(t)) for s, t in some)
                    continue
                self.known.update((s, data[a:b]) for (s, _), a, b in zip(some, cuts, cuts[1:]))
        self.known.update((s, self.whole(t)) for s, t in zip(spans, texts) if not t.isalpha())


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""
    ship(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = only(("words", tokenizer), lambda: WordIds(tokenizer))
        for batch in trimmed(batches):
            for part in by_bytes(batch):
                out: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist())):
                    ids += b"\0\0\0\0"
                    for k, first in enumerate(range(0, len(ids) // 4, capacity)):
                        own = ids[4 * first : 4 * (first + capacity)]
                        out.append((doc, k, first, len(own) // 4, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], [n for n, _ in fields])

    return identity(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """The longest that fits, again and again; `lengths` ascends, `left` counts them."""
    out: list[int] = []
    i = bisect_right(lengths, room) - 1
    while i >= 0:
        x = lengths[i]
        k = min(left[x], room // x)
        out += [x] * k
        room -= k * x
        i = min(i, bisect_right(lengths, room)) - 1
    return out


def fillings(lengths: list[int], left: dict[int, int], room: int, nodes: int, most: int = 3) -> list[list[int]]:
    """Up to `most` undominated fillings of `room`, least waste first, best fit the first incumbent.

    Branches take lengths in descending order, so a filling is met once; one is given up when even all lengths still open
    cannot beat the incumbent's waste. A filling with room for a length still there is dominated by the one that has it, so only maximal ones count.
    """
    found = [best_fit(lengths, left, room)]
    waste = room - sum(found[0])
    below = [0]
    for x in lengths:
        below.append(below[-1] + x * left[x])
    stack: list[tuple[int, int, list[int], int]] = [(bisect_right(lengths, room), room, [], 0)]
    while stack and nodes and (waste or len(found) < most):
        nodes -= 1
        upto, rest, chosen, used = stack.pop()
        i = min(upto, bisect_right(lengths, rest)) - 1
        if i < 0:
            if rest <= waste and chosen not in found:
                found, waste = [*found, chosen], rest
            continue
        if rest - below[i + 1] > waste:
            continue
        x = lengths[i]
        taken = used if chosen and chosen[-1] == x else 0
        stack.append((i, rest, chosen, 0))
        if taken < left[x]:
            stack.append((i + 1, rest - x, [*chosen, x], taken + 1))
    return sorted(found, key=lambda f: -sum(f))[:most]


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """A lower bound: for each small size k, lengths over capacity - k share no sequence with one of k or more, nor two over half."""
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in range(capacity // 2 + 1):
        large = sum(n for x, n in counts.items() if x > capacity - k)
        half = [(x, n) for x, n in counts.items() if capacity / 2 < x <= capacity - k]
        rest = sum(x * n for x, n in counts.items() if k <= x <= capacity / 2)
        some = sum(n for _, n in half)
        best = max(best, large + some + max(0, -(-(rest - sum((capacity - x) * n for x, n in half)) // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, bins: int = 3000) -> Plan:
    """Where the pieces of each length go: rows (length, first rank, ranks, first sequence, offset), sequences used, lower bound.

    A bin is completed around the largest length left, as often as the counts allow. Where the first descent misses the bound, the
    search goes back over up to `bins` bins, to fillings of second choice, and gives a branch up once its waste rules out fewer sequences than the best plan has.
    """
    left = {x: n for x, n in counts.items() if n and x < capacity}
    total, bound = sum(x * n for x, n in left.items()), least_sequences(left, capacity)
    best: list[tuple[list[int], int]] | None = None
    fewest = 0

    def choices(left: dict[int, int]) -> list[list[int]]:
        large = max(left)
        after = left | {large: left[large] - 1}
        return [[large, *f] for f in fillings(sorted(x for x, n in after.items() if n), after, capacity - large, nodes)]

    stack: list[tuple[dict[int, int], list[tuple[list[int], int]], int, int]] = [(left, [], 0, 0)]
    while stack and (best is None or (fewest > bound and bins)):
        left, chosen, waste, used = stack.pop()
        if best is not None:
            bins -= 1
            if waste > (fewest - 1) * capacity - total:
                continue
        if not left:
            if best is None or used < fewest:
                best, fewest = chosen, used
            continue
        for f in reversed(choices(left)):
            each = {x: f.count(x) for x in f}
            times = min(left[x] // k for x, k in each.items())
            rest = {x: n - times * each.get(x, 0) for x, n in left.items() if n > times * each.get(x, 0)}
            stack.append((rest, [*chosen, (f, times)], waste + times * (capacity - sum(f)), used + times))
    full = counts.get(capacity, 0)
    rows: list[tuple[int, int, int, int, int]] = [(capacity, 0, full, 0, 0)] if full else []
    ranks = dict.fromkeys(counts, 0)
    sequence = full
    for f, times in best or []:
        offset = 0
        for x in f:
            rows.append((x, ranks[x], times, sequence, offset))
            ranks[x] += times
            offset += x
        sequence += times
    return Plan(rows, sequence, full + bound)


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS, nodes: int = NODES) -> DataFrame:
    """`pieces` (with doc_id, piece, length and any other columns, whatever their names) with sequence_id and offset."""
    spark = pieces.sparkSession
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(pieces.columns)]
    salted = pieces.select("doc_id", "piece", "length", *[c for c in ("ids_crc32", "start") if c in pieces.columns], F.struct(*kept).alias("kept")).withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "doc_id", "piece", *[c for c in ("ids_crc32", "start") if c in pieces.columns]), F.when(F.col("length") == capacity, F.lit(16 * salts)).otherwise(F.lit(salts))).cast("int"))
    # At most `salts` rows a length, and 16 times that for full ones; only the lengths' counts go to the driver.
    counted = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    made = plan({int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, nodes)
    earlier = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    before = counted.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = W.partitionBy("length", "salt").orderBy("doc_id", "piece", *[c for c in ("ids_crc32", "start") if c in salted.columns])
    ranked = salted.join(F.broadcast(before), ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    table = np.array(sorted(made.rows), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast((table[:, 0] << 40 | table[:, 1], table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = held.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = rows[np.searchsorted(keys, length << 40 | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.column("kept").flatten(), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], [*names, "sequence_id", "offset"])

    ship(spark)
    names = [f"k{i}" for i in range(len(pieces.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, pieces.schema))
    placed = ranked.select("length", "rank", "kept").mapInArrow(run, f"{schema}, sequence_id long, offset long")
    return placed.toDF(*[c for c in pieces.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = cut_documents(docs, tokenizer, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(pieces, "pieces"), capacity)

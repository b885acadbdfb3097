"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's shingles are its runs of five words (a text of fewer words is one shingle; no word, none), hashed to 64 bits. The sketch
retains every hash below a fixed fraction of the hash space, so sketches of the parts of a collection merge by union, and
containment of a small text in a large one is estimated where both were kept alike. A text of few shingles
also keeps its `floor` least hashes, so that short texts compare exactly: its sketch then reaches up to the greatest of those, or over the whole
space if it has no more. Two sketches are compared below the lower of their reaches.

A fingerprint is text: the hashes in ascending order, base64 of big-endian 64-bit integers, after `*` if the sketch holds all shingles.
Null is empty; an empty text has the fingerprint `*`. Two texts without words have likeness 1. A text is sketched whole, however long; other columns are left out.

The next document is the one after in descending order of doc_id (null last; rows of one doc_id by text), after the last the first.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bits_for, identity, ship, sizes
from .words import sequence_hashes, word_hashes

SHINGLE, FRACTION, FLOOR, PART_BYTES = 5, 16, 64, 16 << 20
_MOST = np.uint64(np.iinfo(np.uint64).max)


class Sketch:
    """Ascending hashes, all those up to and with `reach`."""

    def __init__(self, hashes: np.ndarray, reach: np.uint64):
        self.hashes, self.reach = hashes, reach

    @classmethod
    def of(cls, shingles: np.ndarray, fraction: int = FRACTION, floor: int = FLOOR) -> Sketch:
        every = np.unique(shingles)
        if len(every) <= floor:
            return cls(every, _MOST)
        limit = np.uint64((1 << 64) // fraction - 1)
        n = int(np.searchsorted(every, limit, side="right"))
        return cls(every[:n], limit) if n >= floor else cls(every[:floor], every[floor - 1])

    def text(self) -> str:
        return ("*" if self.reach == _MOST else "") + base64.b64encode(self.hashes.astype(">u8").tobytes()).decode()

    @classmethod
    def parse(cls, text: str, fraction: int = FRACTION) -> Sketch:
        hashes = np.frombuffer(base64.b64decode(text.lstrip("*")), ">u8").astype(np.uint64)
        limit = np.uint64((1 << 64) // fraction - 1)
        return cls(hashes, _MOST if text.startswith("*") else max(hashes[-1], limit))

    def merge(self, other: Sketch, fraction: int = FRACTION, floor: int = FLOOR) -> Sketch:
        """The sketch of both texts' shingles together."""
        reach = min(self.reach, other.reach)
        both = np.union1d(self.hashes, other.hashes)
        if reach == _MOST:
            return Sketch.of(both, fraction, floor)
        limit = np.uint64((1 << 64) // fraction - 1)
        both = both[both <= reach]
        n = int(np.searchsorted(both, limit, side="right"))
        return Sketch(both[:n], limit) if n >= floor else Sketch(both[:floor], max(limit, both[:floor][-1]))

    def compare(self, other: Sketch) -> tuple[int, int, int]:
        """Hashes of this, of the other and in both, as far as both reach."""
        reach = min(self.reach, other.reach)
        a, b = self.hashes[self.hashes <= reach], other.hashes[other.hashes <= reach]
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity."""
        a, b, both = self.compare(other)
        return both / (a + b - both) if a + b else 1.0

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has too."""
        a, _, both = self.compare(other)
        return both / a if a else 1.0


def sketches(texts: list[bytes], fraction: int = FRACTION, floor: int = FLOOR) -> list[Sketch]:
    counts, words = word_hashes(texts)
    value, doc, _ = sequence_hashes(words[0], counts, SHINGLE, short=True)
    return [Sketch.of(s, fraction, floor) for s in np.split(value, np.searchsorted(doc, np.arange(1, len(texts))))] if texts else []


def fingerprint_documents(docs: DataFrame, fraction: int = FRACTION, floor: int = FLOOR) -> DataFrame:
    """doc_id, fingerprint of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [s.text() for s in sketches(batch.column(1).to_pylist(), fraction, floor)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "fingerprint"])

    return identity(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """`text` with its last third replaced by as many first characters of the next."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compare_with_next(docs: DataFrame, fraction: int = FRACTION, floor: int = FLOOR) -> DataFrame:
    """doc_id, n_chars, edited text, both fingerprints, likeness to the edited text and to the next document.

    Rows are dealt into ranges of doc_id and stream through each in order; the first row of the range below goes along, so
    every row meets its next one and each text is shuffled once, but for one in a range.
    """
    spark = docs.sparkSession
    ship(spark)
    n, size = sizes(docs)
    parts = int(max(1, min(size // PART_BYTES, 20_000)))
    bounds = [] if parts == 1 or not n else sorted(set(docs.filter("doc_id is not null").agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / parts for k in range(1, parts)], 100 * parts)).first()[0] or []))
    rows = identity(docs).select("doc_id", "text")
    spread = rows.withColumn("part", _part(bounds))
    tops = {r["part"]: r["top"] for r in spread.groupBy("part").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # The greatest doc_id of each range is the next of the range above; that of the highest follows the lowest.
    above = spark.createDataFrame([(tops[p], order[(k + 1) % len(order)]) for k, p in enumerate(order)], "doc_id long, part int")
    carried = rows.alias("r").join(F.broadcast(above.alias("a")), F.col("r.doc_id").eqNullSafe(F.col("a.doc_id"))).select("r.doc_id", "text", F.col("a.part"))
    both = spread.withColumn("carried", F.lit(0)).unionByName(carried.withColumn("carried", F.lit(1)))
    streams = both.repartitionById(len(bounds) + 2, F.col("part").cast("int")).sortWithinPartitions("part", "carried", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple]:
            """Each row with the text after it."""
            last = None
            closed = False
            for batch in batches:
                for doc, text, part, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "carried"))):
                    if last is not None and last[2] == part and not closed:
                        yield (last[0], last[1], text)
                    closed = bool(extra)
                    last = (doc, text, part)

        def flush(some: list[tuple]) -> pa.RecordBatch:
            texts = [t.decode() for _, t, _ in some]
            changed = [edited(t, f.decode()) for t, (_, _, f) in zip(texts, some)]
            # Most next texts are the rows that follow, so each text is sketched once but for the last.
            own = sketches([t for _, t, _ in some] + [some[-1][2]], fraction, floor)
            other = sketches([c.encode() for c in changed], fraction, floor)
            after = [own[i + 1] if i + 1 == len(some) or some[i][2] == some[i + 1][1] else sketches([some[i][2]], fraction, floor)[0] for i in range(len(some))]
            columns = [
                pa.array([d for d, _, _ in some], pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(changed, pa.string()),
                pa.array([s.text() for s in own[:-1]], pa.string()), pa.array([s.text() for s in other], pa.string()),
                pa.array([a.likeness(b) for a, b in zip(own, other)], pa.float64()), pa.array([a.likeness(b) for a, b in zip(own, after)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        some, size = [], 0
        for row in pairs():
            some.append(row)
            size += len(row[1])
            if size > 1 << 20:
                yield flush(some)
                some, size = [], 0
        if some:
            yield flush(some)

    return streams.mapInArrow(run, "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _part(bounds: list[int]) -> Column:
    """The range of doc_id, from 1, by halving over the bounds in a few steps; 0 for null."""
    depth = bits_for(len(bounds) + 1)
    padded = F.array(*[F.lit(b).cast("long") for b in [*bounds, *[(1 << 63) - 1] * ((1 << depth) - 1 - len(bounds))]])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(depth))])
    found = F.aggregate(steps, F.lit(1), lambda at, step: at + F.when(padded[at + step - 2] < F.col("doc_id"), step).otherwise(0)) if depth else F.lit(1)
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(found)

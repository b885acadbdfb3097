"""Centroid clustering (Lloyd's rounds) over an incremental distance matrix, in exact integers.

A kept vector has exactly `dim` components, none null, NaN or infinite; component x becomes floor(scale * x). Vectors live in blocks, each with its vectors
and, persisted beside them, every vector's dot product with every centroid. A round adds to those products only what the components that have changed
add (delta of a centroid, its nonzero components), takes the argmin of |c|^2 - 2 v.c, and sums the vectors of each cluster; the sums, at most
k * (dim + 2) whole numbers, meet on the driver, which floors the means and sends back the changes. No vector is shuffled, and none is sent anywhere
but to the next round's table in the shared folder; the table before goes once that is complete, so a lost executor costs its tasks of one round.

All arithmetic is exact: 64-bit (or double, below 2**53) where the magnitudes allow it, Python's integers for vectors or centroids of any size beyond.
Sums leave a task in limbs of 30 bits.

Defined results: the centroids start as the k kept vectors of smallest sha256 hex of `3:<vec_id>`, ties by components, rows of null vec_id only after all others;
fewer vectors than k make fewer centroids. A tie goes to the smaller number, an empty cluster keeps its centroid. Rows with null vec_id and repeated rows
are clustered like others. Distances and inertias beyond a long are null. Null embeddings and those of other lengths are left out; other columns are not read.
An empty table, or one without a kept vector, gives no row.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, ship, stored

DIM, CENTROIDS, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors a block, the largest component of a vector that shares a block with others of its kind, and the bits of a limb.
BLOCK, NARROW, LIMB = 4096, 1 << 26, 30
STATE = "ids array<long>, vectors binary, dots binary, limb int, sums array<long>"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def pack(a: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 16, 32 and 64 bits, or as text where none holds them."""
    if a.dtype != object:
        for tag, kind in ((b"h", "<i2"), (b"i", "<i4"), (b"q", "<i8")):
            if not a.size or np.iinfo(kind).min <= a.min() and a.max() <= np.iinfo(kind).max:
                return tag + a.astype(kind).tobytes()
    return b"j" + json.dumps(a.tolist()).encode()


def unpack(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"j":
        return np.array(json.loads(data[1:]), object).reshape(-1, width)
    return np.frombuffer(data, {b"h": "<i2", b"i": "<i4", b"q": "<i8"}[data[:1]], offset=1).astype(np.int64).reshape(-1, width)


def largest(a: np.ndarray) -> int:
    return max(int(a.max()), -int(a.min())) if a.size else 0


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact matrix product of whole numbers."""
    bound = largest(a) * largest(b) * max(a.shape[1], 1)
    if bound < 1 << 53:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64) if bound < 1 << 62 else a.astype(object) @ b.astype(object)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact sum of whole numbers."""
    return a + b if a.dtype != object and b.dtype != object and largest(a) + largest(b) < 1 << 62 else a.astype(object) + b.astype(object)


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), for doubles of any size (scale: a power of two)."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not x.size or np.abs(y).max() < 1 << 62:
        return y.astype(np.int64)
    return np.array([[math.floor(v * scale) if abs(v) < 1 << 60 else int(v) * scale for v in row] for row in x.tolist()], object).reshape(x.shape)


def update(dots: np.ndarray, vectors: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after the centroids have moved by `change`: only components that have moved are read."""
    out = [dots[:, k] for k in range(dots.shape[1])]
    for k, row in enumerate(change):
        moved = np.flatnonzero(row)
        if len(moved):
            out[k] = added(out[k], product(vectors[:, moved], row[moved][:, None])[:, 0])
    wide = any(x.dtype == object for x in out)
    return np.stack([x.astype(object) if wide else x for x in out], axis=1)


def nearest(dots: np.ndarray, vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each vector and the squared distance to its centroid."""
    own = np.array([sum(int(x) * int(x) for x in c) for c in centroids], object)
    if dots.dtype != object and largest(own) + 2 * largest(dots) < 1 << 62:
        own = own.astype(np.int64)
    score = added(own[None, :], -2 * dots if own.dtype != object else -2 * dots.astype(object))
    best = np.argmin(score, axis=1).astype(np.int64)
    square = (vectors * vectors).sum(axis=1) if vectors.dtype != object else np.array([sum(x * x for x in v) for v in vectors.tolist()], object)
    return best, added(square, score[np.arange(len(best)), best])


def limbs(sums: list[int]) -> list[list[int]]:
    """Whole numbers as signed limbs, lowest first; one limb at least."""
    out, left = [], [abs(x) for x in sums]
    while any(left) or not out:
        out.append([(x & (1 << LIMB) - 1) * (-1 if s < 0 else 1) for x, s in zip(left, sums)])
        left = [x >> LIMB for x in left]
    return out


class Totals:
    """A task's sums by cluster: the components, the squared distances and the vectors."""

    def __init__(self, k: int, dim: int):
        self.k, self.sums = k, np.zeros((k, dim + 2), object)

    def add(self, vectors: np.ndarray, best: np.ndarray, distance: np.ndarray) -> None:
        member = (best[None, :] == np.arange(self.k)[:, None]).astype(np.int64)
        self.sums[:, :-2] += product(member, vectors).astype(object)
        self.sums[:, -2] += product(member, distance[:, None])[:, 0].astype(object)
        self.sums[:, -1] += member.sum(axis=1).astype(object)

    def batch(self) -> pa.RecordBatch:
        rows = limbs([int(x) for x in self.sums.ravel()])
        none = pa.nulls(len(rows))
        columns = [none.cast(pa.list_(pa.int64())), none.cast(pa.binary()), none.cast(pa.binary()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "vectors", "dots", "limb", "sums"])


def _block(ids: pa.Array, vectors: np.ndarray, dots: np.ndarray) -> pa.RecordBatch:
    held = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([pack(vectors)], pa.binary()), pa.array([pack(dots)], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(held, ["ids", "vectors", "dots", "limb", "sums"])


def _first(kept: DataFrame, centroids: np.ndarray, dim: int, scale: int) -> DataFrame:
    """Blocks of the vectors with their products, and the sums of their first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(len(centroids), dim)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                values = integers(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                wide = np.abs(values).max(axis=1) > NARROW
                for some in (np.flatnonzero(~wide), np.flatnonzero(wide)):
                    if len(some):
                        vectors = values[some].astype(np.int64) if not wide[some[0]] else values[some].astype(object)
                        dots = product(vectors, centroids.T)
                        totals.add(vectors, *nearest(dots, vectors, centroids))
                        yield _block(batch.column("vec_id").take(pa.array(some)), vectors, dots)
        yield totals.batch()

    return kept.mapInArrow(run, STATE)


def _next(state: DataFrame, centroids: np.ndarray, change: np.ndarray, dim: int) -> DataFrame:
    """The same after the centroids have moved by `change` to where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = Totals(len(centroids), dim)
        for batch in batches:
            for i in range(batch.num_rows):
                vectors = unpack(batch.column("vectors")[i].as_py(), dim)
                dots = update(unpack(batch.column("dots")[i].as_py(), len(centroids)), vectors, change)
                totals.add(vectors, *nearest(dots, vectors, centroids))
                yield _block(batch.column("ids").slice(i, 1).flatten(), vectors, dots)
        yield totals.batch()

    return state.filter("limb is null").mapInArrow(run, STATE)


def _sums(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """The sums of all tasks: a row for each cluster; limbs times k * (dim + 2) numbers reach the driver."""
    parts = state.filter("limb is not null").select("limb", F.posexplode("sums").alias("place", "value")).groupBy("limb", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value"))
    out = np.zeros(k * (dim + 2), object)
    for r in parts.collect():
        out[r["place"]] += int(r["value"]) << LIMB * r["limb"]
    return out.reshape(k, dim + 2)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, squared distance, inertia of the cluster and of all, sha256 of the final centroid; vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    ship(spark)
    odd = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter((F.size("x") == dim) & ~odd)
    order = [F.col("vec_id").isNull(), F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), F.col("x")]
    begin = kept.orderBy(*order).limit(k).collect()
    if not begin:
        return spark.createDataFrame([], RESULT)
    centroids = integers(np.array([r["x"] for r in begin], float), scale)
    state, path = stored(_first(kept, centroids, dim, scale), "centroids")
    sums = _sums(state, len(centroids), dim)
    for _ in range(rounds):
        moved = [[int(s) // int(row[-1]) for s in row[:-2]] if row[-1] else [int(x) for x in old] for row, old in zip(sums, centroids)]
        after = np.array(moved, object)
        after = after.astype(np.int64) if largest(after) < 1 << 62 else after
        change = added(after, -centroids)
        if not change.any():
            break  # no centroid moves any more, so no assignment would change
        centroids = after
        (state, path), before = stored(_next(state, centroids, change, dim), "centroids"), path
        discard(spark, before)
        sums = _sums(state, len(centroids), dim)
    digests = [sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    within, total = [int(x) for x in sums[:, -2]], int(sums[:, -2].sum())

    def fits(x: int) -> int | None:
        return int(x) if x < 1 << 63 else None

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = unpack(batch.column("vectors")[i].as_py(), dim)
                best, distance = nearest(unpack(batch.column("dots")[i].as_py(), len(centroids)), own, centroids)
                n = len(best)
                columns = [
                    batch.column("ids").slice(i, 1).flatten(), pa.array(best.astype(np.int32)), pa.array([fits(x) for x in distance.tolist()], pa.int64()),
                    pa.array([fits(x) for x in within], pa.int64()).take(pa.array(best)), pa.array([fits(total)] * n, pa.int64()), pa.array(digests).take(pa.array(best)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return state.filter("limb is null").mapInArrow(tell, RESULT)

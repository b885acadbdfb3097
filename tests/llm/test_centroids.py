"""Centroid clustering against its SQL, plain Python and edge rows."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidemark.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, distance string"


def brute(rows, k=8, rounds=10, dim=64, scale=1024):
    kept = [(i, [math.floor(x * scale) if abs(x) < 2**60 else int(x) * scale for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))
    at = [list(r[1]) for r in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        said = [near(v)[1] for _, v, _ in kept]
        for i in range(len(at)):
            own = [v for s, (_, v, _) in zip(said, kept) if s == i]
            if own:
                at[i] = [sum(x) // len(own) for x in zip(*own)]
    ends = [(i, *near(v)) for i, v, _ in kept]
    within = [sum(d for _, d, c in ends if c == i) for i in range(len(at))]
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, c, fits(d), fits(within[c]), fits(sum(within)), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, d, c in ends), key=str)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", ["small", "middle"])
def test_clusters_equal_their_sql(spark, request, size):
    folder = request.getfixturevalue(size)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = con.execute(f"SELECT vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 FROM ({queries.oracle_sql()['op13_centroids']})").fetchall()
    assert told(queries.centroids_query(spark, folder)) == sorted(want, key=str)


def test_clusters_of_edge_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(60)]
    same = [0.25] * 64
    rows += [(100 + i, same) for i in range(20)] + [(3, rows[3][1]), (None, same), (None, None), (200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65)]
    rows += [(204, [float("nan")] + same[1:]), (205, [float("inf")] + same[1:]), (206, [None] + same[1:])]
    df = spark.createDataFrame([(i, v, None, 7, "x") for i, v in rows], SCHEMA)
    assert told(centroids.cluster(df)) == brute(rows)
    assert told(centroids.cluster(df.repartition(5))) == brute(rows)
    assert told(centroids.cluster(df.limit(0))) == []
    assert told(centroids.cluster(df.filter("vec_id > 200"))) == []
    few = rows[:3]
    assert told(centroids.cluster(df.limit(3))) == brute(few)


@pytest.mark.parametrize("size", [1e5, 1e9, 1e30, 1e300, 1.7e308])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 0.2, 64).tolist()) for i in range(40)] + [(50 + i, (rng.normal(0, 0.3, 64).clip(-1, 1) * size).tolist()) for i in range(6)]
    df = spark.createDataFrame([(i, v, None, 7, "x") for i, v in rows], SCHEMA).repartition(3)
    got = told(centroids.cluster(df))
    assert got == brute(rows)
    assert any(d is None for _, _, d, *_ in got) == (size >= 1e9 and any(r[2] is None for r in brute(rows)))


def test_updated_products_equal_fresh_ones():
    rng = np.random.default_rng(1)
    v, old = rng.integers(-600, 600, (500, 64)), rng.integers(-600, 600, (8, 64))
    new = np.where(rng.random((8, 64)) < 0.1, old + 3, old)
    assert (centroids.update(v @ old.T, v, new - old) == v @ new.T).all()
    assert [sum(x << 30 * i for i, x in enumerate(col)) for col in zip(*centroids.limbs([-(2**200) + 7, 5, 0]))] == [-(2**200) + 7, 5, 0]

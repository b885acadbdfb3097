"""Search over K2-treaps against its SQL, plain Python and edge rows."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, treap

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, n long, place long, terms string"


def terms(text):
    return [t.lower() for t in TERM.findall((text or "").encode())]


def brute(docs, items, k=50):
    """(item_id, rank, doc_id, score) by summing every term of every document."""
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = Counter()
    for i, own in asked.items():
        found = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in own if t in b)
            if d is not None and score > 0:
                found.append((-score, d))
        out.update((i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1))
    return out


def told(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("size", ["small", "middle"])
def test_search_equals_its_sql(spark, request, size):
    folder = request.getfixturevalue(size)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = Counter(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.oracle_sql()['op11_treap']})").fetchall())
    assert told(queries.treap_query(spark, folder)) == want


@pytest.mark.parametrize("k, shard_docs, group_bytes", [(50, 1 << 14, 1 << 23), (3, 60, 900)])
def test_search_equals_brute_force(spark, small, k, shard_docs, group_bytes):
    rng = np.random.default_rng(k)
    docs = [(int(i), " ".join(f"W{x}" for x in rng.zipf(1.4, rng.integers(1, 80)) % 300)) for i in rng.permutation(260)]
    docs += [(1000 + i, "the same words in all of these copies w1 w2") for i in range(60)] + docs[:5] + [(7, "w1 w1 w1")]
    docs += [(None, "w1 w2 w3"), (5000, None), (5001, ""), (5002, " .,;!\n\t"), (5003, "É日本 naïve_x-y É"), (5004, "w1 " * 50_000 + "w5 w9")]
    items = [(i, docs[i][1][:60] + " unseen") for i in range(12)] + [(20, "w1 w2 the SAME"), (20, "w3 w3"), (21, None), (22, "...") , (None, "w1"), (23, "nowhere"), (24, "é日本 naïve É日本 y")]
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], SCHEMA).repartition(3)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, score int")
    assert told(treap.top_k(d, q, k, shard_docs, group_bytes, 2)) == brute(docs, items, k)
    assert told(treap.top_k(d.limit(0), q, k)) == told(treap.top_k(d, q.limit(0), k)) == Counter()


def test_cells_hold_the_greatest_impact():
    rng = np.random.default_rng(2)
    place = rng.choice(100 * 700, 900, replace=False)
    rows, columns, impacts = place // 700, place % 700, rng.integers(1, 1000, 900)
    tree = treap.Treap(rows, columns, impacts)
    nodes, low = np.zeros((1, 1), np.int64), np.zeros((1, 2), np.int64)
    seen = [(low[0], int(tree.maxima[0][0]))]
    for level in range(tree.height):
        size = 1 << tree.height - level
        ask = np.arange(4)[None, :]
        below, most = tree.children(level, nodes, ask)
        i, quadrant = np.nonzero(below >= 0)
        low = low[i] + np.stack([quadrant >> 1, quadrant & 1], axis=1) * (size // 2)
        nodes = below[i, quadrant][:, None]
        assert len(low) == len(tree.maxima[level + 1]) and (nodes[:, 0] == np.arange(len(low))).all()
        for (r, c), m in zip(low, most[i, quadrant]):
            own = (rows >= r) & (rows < r + size // 2) & (columns >= c) & (columns < c + size // 2)
            assert impacts[own].max() == m
    assert len(low) == 900 and seen[0][1] == impacts.max()


def test_most_ranges_stay_shut(spark, middle):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text").orderBy(F.length("text")).collect()]
    bags = [Counter(terms(t)) for _, t in docs]
    words = sorted({t for b in bags for t in b})
    number = {t: i for i, t in enumerate(words)}
    doc, term, tf = (np.array(x) for x in zip(*[(d, number[t], n) for d, b in enumerate(bags) for t, n in b.items()]))
    weights = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * np.bincount(term) + 1))).astype(np.int64)
    lengths = np.array([sum(b.values()) for b in bags])
    shard = treap.Shard(np.arange(len(docs)), lengths, doc, term, tf, weights, len(docs), int(lengths.sum()))
    item = np.array([number[t] for t in set(terms(docs[-1][1])) if t in number][:30])
    ids, scores, opened = shard.search(item, 5)
    assert len(ids) == 5 and opened < len(docs)

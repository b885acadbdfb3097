"""Search, licences and the pipeline against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import licenses, queries, search
from tidemark.llm.queries import vocabulary

from .test_operators import brute_links, brute_repeats, docs, edge, none, rows_of, words  # noqa: F401


def brute_search(rows, k=10, most=16):
    """BM25 of every document for every query; terms told apart by their text."""
    rows = [r for r in rows if r["doc_id"] is not None]
    bags = [(r["doc_id"], Counter(w.lower() for w in words(r["text"]))) for r in rows]
    n = len(bags)
    mean = sum(sum(b.values()) for _, b in bags) / max(n, 1)
    df = Counter(t for _, b in bags for t in b)

    def impact(tf, size):
        return tf / (tf + search.K1 * (1 - search.B + search.B * size / mean))

    out = {}
    for q, bag in bags:
        if q % 20 or q in out:
            continue
        size = sum(bag.values())
        idf = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in bag}
        value = {t: idf[t] * impact(tf, size) for t, tf in bag.items()}
        ordered = sorted(value, key=lambda t: -value[t])
        if len(ordered) > most and abs(value[ordered[most - 1]] - value[ordered[most]]) < 1e-9:
            out[q] = None  # a tie at the cut goes by hash
            continue
        chosen = ordered[:most]
        scored = sorted(((-sum(idf[t] * (search.K1 + 1) * impact(b[t], sum(b.values())) for t in chosen if t in b), d) for d, b in bags))
        out[q] = [(d, -s) for s, d in scored[:k] if s < 0]
    return out


@pytest.mark.parametrize("shard_bytes, terms", [(1 << 30, 16), (60_000, 16), (60_000, 10_000)])
def test_search_equals_brute_force(docs, shard_bytes, terms):  # noqa: F811
    want = brute_search(rows_of(docs), most=terms)
    got = defaultdict(list)
    for r in sorted(rows_of(search.top_k(docs, F.col("doc_id") % 20 == 0, shard_bytes=shard_bytes, query_terms=terms, group_queries=7)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    seen = 0
    for q, best in want.items():
        if best is None:
            continue
        seen += 1
        assert [round(s, 6) for _, s in got[q]] == [round(s, 6) for _, s in best]
        assert {d for d, s in got[q] if s > best[-1][1] + 1e-6} == {d for d, s in best if s > best[-1][1] + 1e-6}
    assert seen >= (len(want) if terms > 100 else 1)


def test_registered_search_uses_the_whole_text(spark, docs, small):  # noqa: F811
    want = {q: best for q, best in brute_search(rows_of(docs), most=10_000).items() if best}
    got = defaultdict(list)
    for r in sorted(rows_of(queries.search_query(spark, small)), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    assert {q: [round(s, 6) for _, s in x] for q, x in got.items()} == {q: [round(s, 6) for _, s in best] for q, best in want.items()}
    for q, best in want.items():
        # Where scores differ, the documents are the same in the same order.
        apart = [i for i, (_, s) in enumerate(best) if all(abs(s - x) > 1e-6 for j, (_, x) in enumerate(best) if j != i)]
        assert [got[q][i][0] for i in apart[:-1]] == [best[i][0] for i in apart[:-1]]


@pytest.mark.parametrize("bound", [{"shard_docs": 9}, {"shard_postings": 2000}, {"shard_docs": 9, "group_queries": 3, "shard_bytes": 50_000}])
def test_search_is_the_same_however_shards_are_bounded(docs, bound):  # noqa: F811
    def found(**kw):
        return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in rows_of(search.top_k(docs, F.col("doc_id") % 20 == 0, **kw)))

    assert found(**bound) == found()


def test_runs_are_of_one_shard_and_kind():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1, 1, 4, 4], pa.int32()), pa.array([False, False, True, False, True])], ["shard", "asks"])
    assert [(n, asks, r.num_rows) for n, asks, r in search._runs([batch, batch.slice(0, 0), batch.slice(4)])] == [(1, False, 2), (1, True, 1), (4, False, 1), (4, True, 1), (4, True, 1)]


def test_long_and_short_searches_agree():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 500).encode() for _ in range(700)]
    texts += texts[:20]
    index = search.Index(np.arange(len(texts)), search.joined([search.postings(texts)]), 30.0)
    df = np.diff(index.firsts)
    for text in texts[::15] + [b" ".join(texts[:5])]:
        own = index.find(np.unique(search.terms([text])[1]))
        weights = search.idf(len(texts), df[own])
        for k in (1, 10, 1000):
            assert index.search_long(own, weights, k) == index.search(list(zip(own.tolist(), weights.tolist())), k)


def test_floors_and_matrices_spare_work(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}{x}" for x in rng.zipf(1.3, rng.integers(20, 90)) % 900).encode() for i in range(900)]
    index = search.Index(np.arange(len(texts)), search.joined([search.postings(texts)]), 50.0)
    index.weight[:] = search.idf(len(texts), np.diff(index.firsts))
    own = [index.find(np.unique(search.terms([text])[1])) for text in texts[::9]]
    blocks = search.Blocks(index, own)
    # A posting is in its cluster's matrix or in its term's list, so no query sums a common term document by document.
    assert sum(np.count_nonzero(t) for t in blocks.tables) + len(blocks.postings) == len(index.doc) > 2 * len(blocks.postings)
    scored = []
    monkeypatch.setattr(index, "exact", lambda near, wanted: scored.append(len(near)) or search.Index.exact(index, near, wanted))
    free, most = blocks.search(10), sum(scored)
    scored.clear()
    floors = np.array([best[4][0] for best in free])
    assert [[x for x in best if x[0] >= f] for best, f in zip(blocks.search(10, floors), floors)] == [best[: sum(s >= f for s, _ in best)] for best, f in zip(free, floors)]
    assert sum(scored) < 0.6 * most


def test_search_alone_takes_floors():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 30)) % 300).encode() for _ in range(600)] * 2
    index = search.Index(np.arange(len(texts)), search.joined([search.postings(texts)]), 15.0)
    index.weight[:] = search.idf(len(texts), np.diff(index.firsts))
    for text in texts[:600:20]:
        own = index.find(np.unique(search.terms([text])[1]))
        query = list(zip(own.tolist(), index.weight[own].tolist()))
        free = index.search(query, 10)
        for floor in {0.0, *(s for s, _ in free), free[-1][0] * 2}:
            assert [x for x in index.search(query, 10, floor) if x[0] >= floor] == [x for x in free if x[0] >= floor]


def test_short_queries_with_many_postings_go_in_batches(spark, monkeypatch):
    # Every document has the common words, so a query of two of them has more postings than are gone through one by one.
    docs_ = spark.createDataFrame([(i, f"the of w{i % 7} " + ("and " * (i % 5)) + (f"u{i} x{i}" if i % 2 else "")) for i in range(400)], "doc_id long, text string").repartition(2)
    found = {}
    for most in (search.WAND_POSTINGS, 1 << 40, 0):
        monkeypatch.setattr(search, "WAND_POSTINGS", most)
        found[most] = sorted(map(tuple, search.top_k(docs_, F.col("doc_id") % 20 == 0, shard_docs=150).collect()))
    assert len(found[0]) == 200 and len(set(map(tuple, found.values()))) == 1
    monkeypatch.undo()
    index = search.Index(np.arange(400), search.joined([search.postings([r["text"].encode() for r in docs_.orderBy("doc_id").collect()])]), 4.0)
    queries_ = [index.find(np.unique(search.terms([text])[1])) for text in (b"the of", b"u1 x1")]
    assert [search.alone(index, x) for x in queries_] == [False, True]


def test_terms_of_many_queries_are_read_together():
    texts = [f"a b c{i % 5} d{i} e{i}".encode() for i in range(50)]
    index = search.Index(np.arange(50), search.joined([search.postings(texts)]), 5.0)
    order = np.lexsort((np.repeat(np.arange(50), np.diff(index.own_firsts)), index.own))
    assert index.at.tolist() == order.tolist() and index.firsts.tolist() == [0, *np.cumsum(np.bincount(index.own)).tolist()]
    assert index.doc.tolist() == np.repeat(np.arange(50), np.diff(index.own_firsts))[order].tolist()
    known = np.sort(np.append(search.terms([b"a b c1 c2"])[1], np.uint64(5)))  # a dictionary, and one term of it that the shard lacks
    numbers = np.arange(len(known)).astype("<u2")
    rare = search.terms([b"d3 e7 missing"])[1]
    # Two rows of one doc_id, a query without common terms, and one without any.
    asked = pa.table({"numbers": pa.array([[numbers[:3].tobytes(), numbers[1:].tobytes()], [], [b""]], pa.list_(pa.binary())), "terms": pa.array([rare.view(np.int64).tolist(), rare[:1].view(np.int64).tolist(), []], pa.list_(pa.int64())), "dfs": pa.array([[1, 1, 1], [1], []], pa.list_(pa.int32()))})
    for table in (asked, pa.concat_tables([asked.slice(0, 1), asked]).slice(1)):
        got = search.asked_terms(index, index.find(known), 50, table)
        want = [index.find(np.unique(np.concatenate([known, rare]))), index.find(rare[:1]), np.zeros(0, int)]
        assert [x.tolist() for x in got] == [np.sort(x[x >= 0]).tolist() for x in want]


def test_search_of_edge_rows(edge, none):  # noqa: F811
    got = rows_of(search.top_k(edge, F.col("doc_id") == 5, k=4))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])][:2] == [5, 5]
    assert rows_of(search.top_k(edge, F.col("doc_id") == 0)) == []
    assert rows_of(search.top_k(none, F.lit(True))) == []


def test_every_license_line_is_found(spark, middle):
    docs_ = spark.read.parquet(f"{middle}/documents.parquet")
    got = {r["file_id"]: r for r in rows_of(licenses.scan_files(queries.license_files(docs_)))}
    named = 0
    for r in rows_of(docs_):
        lines = (r["text"] or "").split("\n")
        want = {k for k, t in licenses.TEMPLATES.items() if t in lines}
        named += bool(want)
        assert (got[r["doc_id"]]["own"] in want) if want else got[r["doc_id"]]["own"] is None
    assert named > 5
    assert any(r["inherited_from"] for r in got.values())


def test_neighbouring_licences_are_told_apart(spark):
    h, t = licenses.HEADERS, licenses.TEMPLATES
    gpl = h["GPL-3.0"]
    texts = {
        "GPL-3.0": gpl, "GPL-2.0": gpl.replace("version 3", "version 2"), "AGPL-3.0": gpl.replace("GNU General", "GNU Affero General"), "LGPL-3.0": gpl.replace("GNU General", "GNU Lesser General"),
        "LGPL-2.1": gpl.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"), "BSD-2-Clause": "Copyright 2020 X\n\n" + "\n".join(x for x in h["BSD-3-Clause"].split("\n") if x[:2] != "3."),
        "BSD-3-Clause": h["BSD-3-Clause"], "Apache-2.0": h["Apache-2.0"], "MIT": h["MIT"], "ISC": h["ISC"], "MPL-2.0": h["MPL-2.0"],
    }
    notes = {"GPL-2.0": t["GPL-3.0"].replace("3", "2"), "AGPL-3.0": t["GPL-3.0"].replace("GNU", "GNU Affero"), None: "why the project was not licensed under the Apache License, version 2.0, at all", "MIT": t["MIT"], "BSD-3-Clause": t["BSD-3-Clause"]}
    rows = [(i, f"d{i}/a.py", "# " + x.replace("\n", "\n# ") + "\n\nimport os\n") for i, x in enumerate(texts.values())] + [(100 + i, f"e{i}/a.py", x) for i, x in enumerate(notes.values())]
    rows += [(1000 + i, f"other/{i}", f"this is line {i} of the work and it is under that\nthe version of it, not another") for i in range(200)]
    got = {r["file_id"]: r["own"] for r in rows_of(licenses.scan_files(spark.createDataFrame(rows, "file_id long, path string, text string")))}
    assert {i: got[i] for i in range(len(texts))} == dict(enumerate(texts)) and {100 + i: got[100 + i] for i in range(len(notes))} == {100 + i: k for i, k in enumerate(notes)}
    assert all(got[1000 + i] is None for i in range(200))


def test_license_inheritance_and_edges(spark):
    t = licenses.TEMPLATES
    rows = [
        (1, "LICENSE", t["MIT"]), (2, "a/x.py", "code"), (3, "a/b/COPYING", "/* " + t["GPL-3.0"].upper() + " */"), (4, "a/b/c/d/y.py", None), (5, "a/b/z.py", "# " + t["Apache-2.0"]),
        (6, None, "nothing"), (7, "ab/y.py", ""), (8, "a/b/NOTICE", t["MPL-2.0"]), (9, "q/LICENSE", "no notice here"), (9, "q/LICENSE", "no notice here"), (10, "q/r", " \n\n"),
    ]
    # Enough other lines for weights as in a corpus.
    rows += [(100 + i, f"other/{i}", f"this is line {i} of the work and it is under that\nthe version of it") for i in range(60)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r["file_id"]: (r["own"], r["inherited_from"], r["license"]) for r in rows_of(licenses.scan_files(files))}
    assert got[1] == ("MIT", None, "MIT")
    assert got[2] == (None, "LICENSE", "MIT")
    assert got[3] == ("GPL-3.0", None, "GPL-3.0")
    assert got[4] == (None, "a/b/COPYING", "GPL-3.0")
    assert got[5] == ("Apache-2.0", None, "Apache-2.0")
    assert got[6] == (None, None, None)
    assert got[7] == got[9] == got[10] == (None, "LICENSE", "MIT")
    assert rows_of(licenses.scan_files(files.limit(0))) == []


def test_pipeline_stages_equal_brute_force(spark, docs, edge, tmp_path):  # noqa: F811
    """Each stage on its own input, over the small table with edge rows."""
    short = ["we walk", "OK", "qq", "w1 w2 w3 w4", "x = y + z; i, j, k", "A B C D E F G", "日本語", "日本語 a", "ДА", "1 2 3"]
    table = docs.unionByName(edge.select(docs.columns).withColumn("doc_id", F.col("doc_id") + 10_000))
    table = table.unionByName(spark.createDataFrame([(20_000 + i, t, None, "s", len(t)) for i, t in enumerate(short)], table.schema))
    (one, two, three, four) = [f for _, f in corpus_pipeline.STAGES]
    first = one(spark, table, "")
    assert first.schema.names == table.schema.names
    kept = Counter((r["doc_id"], r["text"]) for r in rows_of(first))
    letters = {c for r in rows_of(table) if r["lang"] for c in (r["text"] or "").lower() if c.isalpha()}
    assert kept == Counter((r["doc_id"], r["text"]) for r in rows_of(table) if letters & set((r["text"] or "").lower()))
    assert {d for d, _ in kept if d and d >= 20_000} == {20_000 + i for i in (0, 1, 2, 3, 4, 5, 7)}
    before = rows_of(first)
    second = two(spark, first, "")
    groups = {(d, c) for (d, c, *_), n in brute_links(before).items()}
    want = Counter(d for d, c in groups if d == c and d is not None)
    want[None] = sum(r["doc_id"] is None for r in before)
    assert Counter(r["doc_id"] for r in rows_of(second)) == +want
    before = rows_of(second)
    third = three(spark, second, "")
    removed = {d: (n, kept) for d, _, n, kept in brute_repeats(before)}
    texts = {r["doc_id"]: r["text"] for r in before}
    for r in rows_of(third):
        n, kept_text = removed[r["doc_id"]]
        assert r["text"] == (kept_text if n else texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    fourth = rows_of(four(spark, third, ""))
    assert {r["doc_id"] for r in fourth} == {r["doc_id"] for r in rows_of(third)}


def test_pipeline_runs(spark, small):
    got = rows_of(corpus_pipeline.run(spark, small))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got and all(sum(n for _, n in x) <= 2048 for x in by.values())
    assert vocabulary("word_bpe_49k.json")

"""Operators recomputed in plain Python, without their arrays and shuffles."""

import base64
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, language, licenses, queries, scoring, sharding, words

from .test_operators import docs, edge, none, rows_of  # noqa: F401


def test_placement_equals_brute_force(docs, edge):  # noqa: F811
    """Parcels, largest first, each to the shard of the greatest dot product with what is left, where it fits."""
    for table, shards in ((docs, 8), (edge, 3)):
        got = rows_of(sharding.shard_documents(table, shards))
        assert {r["n_words"] for r in got if r["size"] == 1} <= {0}
        sums, where = defaultdict(lambda: [0, 0, 0]), {}
        for r in got:
            s = sums[r["parcel"], r["part"]]
            s[0], s[1], s[2] = s[0] + r["size"], s[1] + r["n_words"], s[2] + 1
            assert where.setdefault((r["parcel"], r["part"]), r["shard"]) == r["shard"]
        whole = [max(sum(v[k] for v in sums.values()) / shards, 1e-9) for k in range(3)]
        left = [[1.0] * 3 for _ in range(shards)]
        for key in sorted(sums, key=lambda k: (-sums[k][0] / whole[0], k)):
            need = [sums[key][k] / whole[k] for k in range(3)]
            fits = [s for s in range(shards) if all(a >= b for a, b in zip(left[s], need))] or [s for s in range(shards) if left[s][0] >= need[0]]
            best = max(fits, key=lambda s: (np.dot(left[s], need), -s)) if fits else max(range(shards), key=lambda s: (left[s][0], -s))
            best = where[key] if best != where[key] and abs(np.dot(left[best], need) - np.dot(left[where[key]], need)) < 1e-9 else best
            assert where[key] == best
            left[best] = [a - b for a, b in zip(left[best], need)]


def shingles(text, n=5):
    w = text.encode().split()
    runs = [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w] if w else []
    out = set()
    for run in runs:
        counts, hashes = words.word_hashes([b" ".join(run)])
        out |= set(words.sequence_hashes(hashes[0], counts, n, short=True)[0].tolist())
    return sorted(out)


def sketch(text):
    every, limit = shingles(text), (1 << 64) // fingerprints.FRACTION - 1
    if len(every) <= fingerprints.FLOOR:
        return every, (1 << 64) - 1
    low = [h for h in every if h <= limit]
    return (low, limit) if len(low) >= fingerprints.FLOOR else (every[: fingerprints.FLOOR], every[fingerprints.FLOOR - 1])


def test_fingerprints_equal_brute_force(docs, edge):  # noqa: F811
    for table in (docs.filter("doc_id < 60"), edge):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
        got = defaultdict(list)
        for r in rows_of(fingerprints.compare_with_next(table)):
            got[r["doc_id"]].append(r)
        for i, (doc, text) in enumerate(rows):
            after = rows[(i + 1) % len(rows)][1]
            k = len(text) // 3
            changed = text[: len(text) - k] + after[:k]
            own, other, following = sketch(text), sketch(changed), sketch(after)

            def near(a, b):
                reach = min(a[1], b[1])
                x, y = {h for h in a[0] if h <= reach}, {h for h in b[0] if h <= reach}
                return len(x & y) / len(x | y) if x | y else 1.0

            want = (changed, *(("*" if s[1] == (1 << 64) - 1 else "") + base64.b64encode(b"".join(h.to_bytes(8, "big") for h in s[0])).decode() for s in (own, other)), near(own, other), near(own, following))
            assert any((r["edited"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == want for r in got[doc]), doc


def test_scores_equal_brute_force(docs, edge):  # noqa: F811
    """The model from exact counts at the filter's levels; with 1024 bits an entry the filter tells hardly any unseen n-gram for a seen one."""
    for table in (docs, edge):
        rows = [(r["doc_id"], r["text"], bool(r["t"])) for r in table.select("doc_id", "text", (~language.held_out(7, 2)).alias("t")).collect()]
        one, two = Counter(), Counter()
        for _, text, train in rows:
            toks = [*(text or "").encode().lower().split(), None]
            if train:
                one.update(toks)
                two.update(zip([None, *toks[:-1]], toks))

        def bounds(count):
            """The least and the greatest count of the level that a count falls into."""
            if not count:
                return 0, 0
            k = 0
            while count >= scoring.BASE ** (k + 1) - 1e-9:
                k += 1
            own = [c for c in range(1, 4 * count + 4) if scoring.BASE**k - 1e-9 <= c < scoring.BASE ** (k + 1) - 1e-9]
            return own[0], own[-1]

        def middle(count):
            return sum(bounds(count)) / 2

        n, v = sum(map(middle, one.values())), len(one)

        got = defaultdict(list)
        for r in rows_of(scoring.score_documents(table, ~language.held_out(7, 2), block_bytes=50_000, bits=1024)):
            got[r["doc_id"]].append(r["score"])
        right = 0
        for doc, text, _ in rows:
            toks, before, near, score = [*(text or "").encode().lower().split(), None], None, False, 0.0
            for t in toks:
                weight = scoring.HIT if near else scoring.MISS
                pair, context = two[before, t], bounds(one[before])[1]
                ratio = min(1.0, bounds(pair)[0] / context) if context else 0.0
                score += math.log10((1 - weight) * (middle(one[t]) + 1) / (n + v + 1) + weight * ratio)
                before, near = t, pair > 0
            right += any(abs(x - score) < 1e-6 * max(1, abs(score)) for x in got[doc])
        assert right >= 0.98 * len(rows)


def test_probabilities_sum_to_at_most_one(spark):
    """All words after one history, the unseen mass left out."""
    texts = [(i, " ".join(f"w{(i * k) % 7}" for k in range(1, 9)), True) for i in range(30)] + [(1000 + i, f"w1 w{i}", False) for i in range(7)]
    got = {r["doc_id"]: r["score"] for r in rows_of(scoring.score_documents(spark.createDataFrame(texts, "doc_id long, text string, train boolean"), F.col("train"), bits=1024))}
    first = {r["doc_id"]: r["score"] for r in rows_of(scoring.score_documents(spark.createDataFrame([*texts[:30], (2000, "w1", False)], "doc_id long, text string, train boolean"), F.col("train"), bits=1024))}[2000]
    assert first < 0 and sum(10 ** got[1000 + i] for i in range(7)) <= 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 11, 16, 40, 100])
def test_successors_of_any_history_sum_to_at_most_one(spark, n):
    """`a` is followed by each of n words, some of them more than once; their probabilities after it, at the registered size of the filter."""
    texts = [(i, f"a w{i % n}", True) for i in range(n + n // 3)] + [(10_000 + i, f"a w{i}", False) for i in range(n)] + [(20_000, "a", False), (20_001, "", False)]
    got = {r["doc_id"]: r for r in rows_of(scoring.score_documents(spark.createDataFrame(texts, "doc_id long, text string, train boolean"), F.col("train")))}

    # score(a w) = P(a|end) P(w|a) P(end|w); the same last factor after every w that occurs as often, and P(a|end) of the text `a` alone.
    rows = [(f"w{i}", got[10_000 + i]["score"]) for i in range(n)]
    level = lambda c: 1 + math.floor(math.log(c) / math.log(scoring.BASE) + 1e-9)
    single = lambda k, total, kinds: (scoring.MIDDLE[k] + 1) / (total + kinds + 1)
    counts = [1 + (i < n // 3) for i in range(n)]
    train = n + n // 3
    total, kinds = sum(scoring.MIDDLE[level(c)] for c in counts) + 2 * scoring.MIDDLE[level(train)], n + 2
    end = single(level(train), total, kinds)
    first = (1 - scoring.MISS) * single(level(train), total, kinds) + scoring.MISS * min(1, scoring.LEAST[level(train)] / scoring.GREATEST[level(train)])
    last = [(1 - scoring.HIT) * end + scoring.HIT * scoring.LEAST[level(c)] / scoring.GREATEST[level(c)] for c in counts]
    after = [10**s / first / z for (_, s), z in zip(rows, last)]
    assert sum(after) <= 1 + 1e-9 and min(after) > 0


def test_licences_equal_brute_force(spark, middle):
    table = spark.read.parquet(f"{middle}/documents.parquet").filter("doc_id % 3 = 0")
    extra = [
        (10_000_001, "x/LICENSE", "Copyright (c) 2020 Someone\n\n" + licenses.HEADERS["MIT"] + "\n"), (10_000_002, "x/a.py", "# " + licenses.HEADERS["Apache-2.0"].replace("\n", "\n# ") + "\n\nimport os\n" * 3),
        (10_000_003, "x/b.py", "Released under the MIT License by Ada Lovelace of Example"), (10_000_004, None, None), (10_000_005, "y", licenses.HEADERS["BSD-3-Clause"]),
    ]
    files = queries.license_files(table).unionByName(spark.createDataFrame(extra, "file_id long, path string, text string"))
    got = {r["file_id"]: r for r in rows_of(licenses.scan_files(files))}

    def terms(text):
        return re.findall(rb"[A-Za-z0-9\x80-\xff]+", text.encode().lower())

    rows = [(r["file_id"], (r["text"] or "").split("\n")) for r in files.collect()]
    df, n = Counter(), 0
    for _, lines in rows:
        for x in lines:
            df.update(set(terms(x)))
            n += bool(terms(x))
    weight = defaultdict(lambda: 1 + math.log(1 + n), {t: 1 + math.log((1 + n) / (1 + c)) for t, c in df.items()})

    def vector(text):
        v = {t: c * weight[t] for t, c in Counter(terms(text)).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    known = sorted([*licenses.TEMPLATES.items(), *licenses.HEADERS.items(), *(x for group in licenses.NEIGHBOURS for x in group.items())])
    vectors = [(name, vector(text), terms(text)) for name, text in known]

    def stated(name, own, said):
        """Whether a text with the terms `said` may state the licence of a template with the terms `own`."""
        said, no = set(said), {x.encode() for x in licenses.NEGATIONS} - set(own)
        return {x.encode() for x in licenses.REQUIRED.get(name, ())} <= said and not {x.encode() for x in licenses.EXCLUDED.get(name, ())} & said and (len(own) >= licenses.LONG or not no & said)

    found = 0
    for file, lines in rows:
        blocks, now = [], []
        for x in [*lines, ""]:
            if terms(x):
                now.append(x)
            elif now:
                blocks, now = [*blocks, "\n".join(now)], []
        scored = [(sum(v[t] * x for t, x in vector(text).items() if t in v), len(own), name) for text in [*lines, *blocks, "\n".join(lines)] for name, v, own in vectors if stated(name, own, terms(text))]
        best = max(((n >= licenses.LONG and c >= licenses.STRONG, c, name) for c, n, name in scored), default=(False, 0, None), key=lambda x: (x[0], round(x[1], 12)))[1:]
        if abs(best[0] - licenses.THRESHOLD) > 1e-9:
            found += best[0] >= licenses.THRESHOLD
            assert got[file]["own"] == (best[1] if best[0] >= licenses.THRESHOLD else None), file
            assert got[file]["similarity"] is None if got[file]["own"] is None else math.isclose(got[file]["similarity"], best[0], abs_tol=1e-9)
    assert found > 4 and [got[10_000_000 + i]["own"] for i in (1, 2, 3, 4, 5)] == ["MIT", "Apache-2.0", "MIT", None, "BSD-3-Clause"]


def test_what_is_written_can_be_cleared(spark):
    from tidemark.llm import shared

    path = shared.written(spark.range(3), "some").inputFiles()[0]
    assert shared.clear_written(spark) >= 1 and shared.clear_written(spark) == 0
    assert not spark.sparkContext._jvm.java.io.File(path.removeprefix("file://")).exists()

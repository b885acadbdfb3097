"""The dealt operators against brute force, public libraries and edge rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fingerprints, language, neardups, packing, pieces, queries, scoring, sharding, substrings
from tidemark.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, rest string, part int, kept string, score double"
LOREM = [f"w{(i * i + 7 * i) % 97}x{i % 13}" for i in range(400)]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    long = " ".join(LOREM * 20)
    texts = [None, "", "   \n\t", "one", "one two three four", " ".join(LOREM[:60]), " ".join(LOREM[:60]), " ".join(LOREM[:59] + ["changed"]), long, " ".join(["la"] * 70), "é\xa0é 日本 \x00 <|endoftext|> <s> ▁", " ".join(LOREM[10:40])]
    rows = [(i, t, None if i % 3 else "en", None, None, 1, "r", 2, "k", 0.5) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id at all", "fr", "s", 1, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    return (text or "").encode().split()


# ---- 1


def check_shards(docs, shards=8):
    got = rows_of(sharding.shard_documents(docs, shards))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    return got


def test_shards_are_near_equal_and_keep_equal_texts(spark, middle):
    got = check_shards(spark.read.parquet(f"{middle}/documents.parquet"))
    for k, near in (("size", 0.01), ("n_words", 0.05)):
        sums = Counter()
        for r in got:
            sums[r["shard"]] += r[k]
        assert max(sums.values()) - min(sums.values()) < near * sum(sums.values()) / 8
    homes = defaultdict(set)
    for r in got:
        homes[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


def test_shards_of_edge_rows(edge, none, spark):
    check_shards(edge)
    assert rows_of(sharding.shard_documents(none)) == []
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "the same text again").otherwise(F.concat(F.lit("text number "), "id")).alias("text")).withColumnRenamed("id", "doc_id")
    sums = Counter()
    for r in check_shards(hot):
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) < 1.05 * min(sums.values())


# ---- 2


def check_pieces(docs):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = Counter((r["doc_id"], r["ids"].hex() if isinstance(r["ids"], bytes) else bytes(r["ids"]).hex(), r["decoded"]) for r in rows_of(pieces.encode_documents(docs, vocabulary("piece_bpe_32k.model"))))
    want = Counter()
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        want[r["doc_id"], np.array(ids, "<u4").tobytes().hex(), lib.decode(ids)] += 1
    assert got == want


def test_pieces_equal_the_library(docs, edge, none):
    check_pieces(docs)
    check_pieces(edge)
    assert rows_of(pieces.encode_documents(none, vocabulary("piece_bpe_32k.model"))) == []


def test_pieces_of_strange_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    own = pieces.model(vocabulary("piece_bpe_32k.model"))

    @settings(max_examples=400, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aeinrst  ▁\n.,'<>x0"), st.characters(exclude_categories=["Cs"])), max_size=60))
    def same(text):
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert own.encode(text) == np.array(ids, "<u4").tobytes()
        assert own.decode(own.encode(text)) == lib.decode(ids)

    same()
    for text in ("a" * 5000, "the" * 3000, " " * 999 + "x", "ab" * 700 + "é"):
        assert own.encode(text) == np.array(lib.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()


def test_pieces_of_long_runs_of_characters_that_never_merge():
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    own = pieces.model(vocabulary("piece_bpe_32k.model"))
    han = [chr(c) for c in range(0x4E00, 0x9FFF) if chr(c) in own.known]
    for text in ("0123456789" * 2000, "".join(han[i * i % len(han)] for i in range(20_000)), "the 7" + "19" * 5000 + "th 中" * 500):
        assert own.encode(text) == np.array(lib.encode(text, add_bos=True, add_eos=True), "<u4").tobytes()
        assert own.decode(own.encode(text)) == text


@pytest.mark.parametrize("data", [b"\xff", b"\xe3\x81", b"ab\xf0\x9f", b"\xc3\xa9\xc3"])
def test_decoding_of_broken_bytes(data):
    from sentencepiece import SentencePieceProcessor

    lib = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    own = pieces.model(vocabulary("piece_bpe_32k.model"))
    ids = [own.byte_ids[b] for b in data]
    assert own.decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids)


# ---- 3


def test_language_held_out_accuracy(spark, middle):
    docs = spark.read.parquet(f"{middle}/documents.parquet")
    held = language.held_out(5, 0)
    out = language.identify(docs, language.references(docs.filter(~held))).select("lang_pred", "score", F.col("rest.lang").alias("lang"), held.alias("held"))
    rows = [r for r in out.collect() if r["held"]]
    assert len(rows) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_edge_rows(edge, none):
    refs = {"en": " the and of that with ", "fr": " le la les des une "}
    said = {(r["doc_id"], bytes(r["text"]).decode()): (r["lang_pred"], r["score"]) for r in rows_of(language.identify(edge, refs))}
    assert said[0, ""] == said[2, "   \n\t"] == ("und", 0.0)
    assert said[9, " ".join(["la"] * 70)][0] == "fr"
    assert rows_of(language.identify(none, refs)) == []
    assert {r["lang_pred"] for r in rows_of(language.identify(edge, {}))} == {"und"}
    assert language.references(none) == {}


def test_labelled_sample_is_bounded(spark):
    """Rows without doc_id, of one doc_id, repeated, and very long: few go into the sample, and each language has its share."""
    rows = [(None, f"kein Wort {'abcdefghij'[i % 10] * (i // 10 + 1)}", "de") for i in range(3000)] + [(7, f"one two {'abcdefghij'[i % 10] * (i // 10 + 1)}", "en") for i in range(300)]
    rows += [(10_000 + i, "toujours la même chose", "fr") for i in range(300)] + [(20_000, "pa aqui " * 300_000, "es"), (None, "1 2 3", "xx"), (30_000, None, "en")] + [(20_001, "otra vez", "es")] * 50
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    refs = language.references(table)
    assert sorted(refs) == ["de", "es", "fr"] or sorted(refs) == ["de", "en", "es", "fr"]
    assert all(len(t) <= 2 * language.SAMPLE_LETTERS // 5 for t in refs.values()) and len(refs["es"]) > language.SAMPLE_LETTERS // 6
    assert 2 <= refs["de"].count("kein wort ") <= 4 * language.SAMPLE_DOCS and refs["fr"].count("toujours") <= 4 * language.SAMPLE_DOCS
    assert language.references(table.repartition(2)) == refs
    said = rows_of(language.identify(table.filter("doc_id = 20000 or doc_id is null").limit(20), refs))
    assert len(said) == 20 and {r["lang_pred"] for r in said} <= {*refs, "und"}
    small = language.references(table, 4, 500)
    assert all(len(t) <= 200 for t in small.values()) and "de" in small


def test_suffix_automaton_takes_longest_matches():
    from hypothesis import given
    from hypothesis import strategies as st

    @given(st.text("ab ", max_size=30), st.text("abc ", max_size=30))
    def same(ref, text):
        i = n = 0
        while i < len(text):
            k = max((k for k in range(1, len(text) - i + 1) if text[i : i + k] in ref), default=1)
            i += k
            n += 1
        assert language.SuffixAutomaton(ref).phrases(text) == n

    same()


# ---- 4


def brute_links(rows, threshold=0.8):
    sets, first, members = {}, {}, defaultdict(int)
    for r in sorted((r for r in rows if r["doc_id"] is not None and words(r["text"])), key=lambda r: r["doc_id"]):
        w = tuple(words(r["text"]))
        first.setdefault(w, r["doc_id"])
        members[w] += 1
        sets[first[w]] = {w[i : i + 5] for i in range(max(1, len(w) - 4))}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if len(sets[i]) >= threshold * len(sets[j]) and len(sets[j]) >= threshold * len(sets[i]) and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for r in rows:
        w = tuple(words(r["text"]))
        if r["doc_id"] is None or not w:
            out.append((r["doc_id"], r["doc_id"], r["doc_id"], 1, 0))
        else:
            c = first[w]
            out.append((r["doc_id"], find(c), c, members[w], links[c]))
    return Counter(out)


def near(docs):
    return Counter((r["doc_id"], r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in rows_of(neardups.near_duplicates(docs)))


def test_near_duplicates_equal_brute_force(docs, edge, none):
    assert near(docs) == brute_links(rows_of(docs))
    assert near(edge) == brute_links(rows_of(edge))
    assert near(none) == Counter()


def test_large_cluster_is_cut_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardups, "BLOCK_ROWS", 16)
    base = LOREM[:300]
    docs = spark.createDataFrame([(i, " ".join(base[: i % 290] + [f"new{i}"] + base[i % 290 + 1 :])) for i in range(80)], "doc_id long, text string")
    assert near(docs) == brute_links(rows_of(docs))


def test_bands_reach_the_recall():
    bands, rows = neardups.bands_and_rows(0.8, 0.998, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.998


# ---- 5


def check_packing(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = rows_of(packing.pack_documents(docs, vocabulary("word_bpe_49k.json")))
    want = Counter()
    for r in docs.collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[r["doc_id"], k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by), -(-sum(r["length"] for r in got) // 2048)


def test_packing(docs, edge, none):
    used, bound = check_packing(docs)
    assert used <= max(bound, packing.least_sequences(Counter(r["length"] for r in rows_of(packing.cut_documents(docs, vocabulary("word_bpe_49k.json")))))) + 1
    check_packing(edge)
    assert rows_of(packing.pack_documents(none, vocabulary("word_bpe_49k.json"))) == []


def test_word_ids_equal_the_library():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), packing.WordIds(vocabulary("word_bpe_49k.json"))

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeI'stRe .,\n\t\xa0é́İΣς1<|>"), st.characters(exclude_categories=["Cs"])), max_size=40), max_size=4))
    def same(texts):
        assert own.encode([t.encode() for t in texts]) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]

    same()


def test_plan_completes_bins():
    assert packing.plan({7: 1, 6: 1, 4: 1, 3: 1}, 10).sequences == 2
    # Best fit alone would open a fourth: 6 + 4, 5 + 5 and 5 + 3 + 2 need completion.
    assert packing.plan({6: 1, 5: 3, 4: 1, 3: 1, 2: 1}, 10).sequences == 3
    assert packing.plan({10: 5}, 10).sequences == 5
    assert packing.plan({}, 10).sequences == 0
    rng = np.random.default_rng(1)
    counts = Counter(rng.integers(1, 2049, 20_000).tolist())
    made = packing.plan(counts)
    assert made.sequences <= made.bound * 1.01
    placed = Counter()
    for length, _, times, _, _ in made.rows:
        placed[length] += times
    assert placed == counts


# ---- 6


def brute_repeats(rows, width=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, (rows[i]["text"] or "").encode()))
    seen, out = set(), Counter()
    for i in order:
        w = words(rows[i]["text"])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[rows[i]["doc_id"], len(w), sum(gone), kept.decode()] += 1
    return out


def repeats(docs, **more):
    return Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows_of(substrings.remove_repeats(docs, **more)))


def test_repeats_equal_brute_force(spark, docs, edge, none, middle):
    assert repeats(docs, block_bytes=50_000) == brute_repeats(rows_of(docs))
    assert repeats(edge, block_bytes=2_000) == brute_repeats(rows_of(edge))
    assert repeats(none) == Counter()
    more = spark.read.parquet(f"{middle}/documents.parquet")
    assert repeats(more, block_bytes=300_000) == brute_repeats(rows_of(more))


def test_repeats_pass_other_columns_through(edge):
    got = substrings.remove_repeats(edge)
    assert got.select("rest.*").columns == [c for c in edge.columns if c not in ("doc_id", "text")]
    assert Counter(r["rest"]["kept"] for r in rows_of(got)) == Counter(r["kept"] for r in rows_of(edge))


# ---- 8


def test_fingerprints_of_next_and_edited(docs, edge, none):
    for table in (docs, edge):
        rows = sorted(rows_of(table), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), (r["text"] or "").encode()))
        texts = [r["text"] or "" for r in rows]
        after = texts[1:] + texts[:1]
        want = Counter((r["doc_id"], len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()) for r, t, n in zip(rows, texts, after))
        got = rows_of(fingerprints.compare_with_next(table))
        assert Counter((r["doc_id"], r["n_chars"], hashlib.sha256(r["edited"].encode()).hexdigest()) for r in got) == want
        assert all(0 <= r[k] <= 1 for r in got for k in ("near_edited", "near_next"))
    assert rows_of(fingerprints.compare_with_next(none)) == []
    assert {r["fingerprint"] for r in rows_of(fingerprints.fingerprint_documents(edge)) if r["doc_id"] in (5, 6)}.__len__() == 1


def test_fingerprints_over_many_ranges(docs, monkeypatch):
    one = Counter(map(str, rows_of(fingerprints.compare_with_next(docs))))
    monkeypatch.setattr(fingerprints, "PART_BYTES", 20_000)
    assert Counter(map(str, rows_of(fingerprints.compare_with_next(docs)))) == one


def test_sketches_estimate_and_merge():
    base = [f"t{i}" for i in range(6000)]
    text = [" ".join(x).encode() for x in (base[:4000], base[2000:], base[:300])]
    a, b, c = fingerprints.sketches(text)
    assert abs(a.likeness(b) - 1 / 3) < 0.08
    assert c.containment(a) > 0.9 and a.containment(c) < 0.2
    m = a.merge(b)
    assert np.array_equal(m.hashes, np.union1d(a.hashes, b.hashes))
    for s in (a, b, c):
        assert np.array_equal(fingerprints.Sketch.parse(s.text()).hashes, s.hashes)
    short = fingerprints.sketches([b"a b c d e f g", b"a b c d e f h", b"", b"x"])
    assert short[0].likeness(short[1]) == 0.5 and short[2].likeness(short[2]) == 1 and short[2].likeness(short[3]) == 0


# ---- 10


def brute_base(rows):
    def tokens(t):
        return [*(t or "").encode().lower().split(), None]

    def held(r):
        return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2

    c = Counter(t for r in rows if not held(r) for t in tokens(r["text"]))
    n, v = sum(c.values()), len(c)
    return {(r["doc_id"], r["text"]): (held(r), len(tokens(r["text"])), sum(c[t] > 0 for t in tokens(r["text"])), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(r["text"]))) for r in rows}


def test_base_scores_equal_brute_force(docs, edge):
    for table in (docs, edge):
        want = sorted(brute_base(rows_of(table.distinct() if table is docs else table)).items(), key=lambda x: str(x[0][0]) + str(x[1][4]))
        got = {}
        for r in rows_of(scoring.score_documents(table, ~language.held_out(7, 2), block_bytes=50_000)):
            got.setdefault(r["doc_id"], []).append(r)
        for (doc, _), (held, n, known, total, base) in want:
            assert any((not r["train"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total) and abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) for r in got[doc])


def test_model_beats_the_base_on_held_out_texts(spark, middle):
    got = [r for r in rows_of(queries.scoring_query(spark, middle)) if r["held_out"]]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_scores_without_rows_or_training(none, edge):
    assert rows_of(scoring.score_documents(none, F.lit(True))) == []
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in rows_of(scoring.score_documents(edge, F.lit(False))))


def test_filter_keeps_counts_and_its_bound(docs):
    keys = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    lev = scoring.level(np.arange(2, 2002))
    width = 1 << 19  # 8 bits an entry or more
    bits = np.zeros(width, bool)
    for k in range(1, int(lev.max()) + 1):
        for p in scoring.Filter.places(keys[lev >= k], 1, k, width):
            bits[p.astype(np.int64)] = True
    f = scoring.Filter(np.packbits(bits, bitorder="little"), width, 0)
    got = f.levels(keys, 1)
    assert (got >= lev).all() and (got == lev).mean() > 0.9
    rows = rows_of(scoring.score_documents(docs, F.lit(True), max_filter_bytes=512))
    assert all(r["score"] <= 0 for r in rows)


def test_no_ngram_is_left_out(spark):
    """A bigram that occurs once scores above an unseen one, and slices of any size hold all n-grams."""
    rows = [(i, f"a{i} b{i} c{i} d{i}", True) for i in range(300)] + [(1000, "a7 b7", False), (1001, "a7 b8", False)]
    table = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    for most in (1 << 20, 64, 1):
        got = {r["doc_id"]: r["score"] for r in rows_of(scoring.score_documents(table, F.col("train"), block_bytes=1000, max_filter_bytes=most))}
        assert got[1000] > got[1001] + 1
        assert min(got[i] for i in range(300)) > got[1001] + 1
    keys = np.sort(scoring.mix(np.arange(1, 5001, dtype=np.uint64)))
    counts = np.arange(5000) % 4
    for most in (1 << 20, 100):
        lev = scoring.filtered(keys, counts, scoring.BIGRAM, most)
        assert (lev[counts > 0] >= scoring.level(counts[counts > 0])).all() and (lev[counts == 0] > 0).mean() < 0.05


def thue_morse(n):
    """A string of a and b and its complement: polynomial hashes modulo a power of two take them for one, whatever the base."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


def test_crafted_words_are_told_apart(spark, tmp_path):
    one, two = thue_morse(2048)
    tail = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}")], "doc_id long, text string")
    assert [r["n_removed"] for r in rows_of(substrings.remove_repeats(df))] == [0, 0]
    few = spark.createDataFrame([(1, f"{one} x y z u"), (2, f"{two} x y z u")], "doc_id long, text string")
    assert all(r["copy_of"] == r["doc_id"] == r["class_id"] for r in rows_of(neardups.near_duplicates(few)))
    assert len({r["fingerprint"] for r in rows_of(fingerprints.fingerprint_documents(few))}) == 2
    path = vocabulary("word_bpe_49k.json")
    ids = packing.WordIds(path)
    assert ids.encode([one.encode(), two.encode()]) == [ids.whole(one), ids.whole(two)]


def test_repeats_of_bare_and_strict_schemas(spark):
    from pyspark.sql import types as T

    rows = [(1, " ".join(LOREM[:60]), 3), (2, " ".join(LOREM[:60]), 4)]
    strict = T.StructType([T.StructField("doc_id", T.LongType(), False), T.StructField("text", T.StringType(), False), T.StructField("n", T.LongType(), False)])
    for df in (spark.createDataFrame(rows, strict), spark.createDataFrame(rows, strict).select("doc_id", "text")):
        assert [r["n_removed"] for r in sorted(rows_of(substrings.remove_repeats(df)), key=lambda r: r["doc_id"])] == [0, 60]
        assert len(rows_of(neardups.near_duplicates(df))) == len(rows_of(fingerprints.compare_with_next(df))) == 2
    assert [r["rest"]["n"] for r in rows_of(language.identify(spark.createDataFrame(rows, strict), {"en": " one two "}))] == [3, 4]


def test_rows_of_one_doc_id_with_other_texts(spark):
    texts = [" ".join(LOREM[a : a + 40]) for a in (0, 50, 100)]
    df = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[0])], "doc_id long, text string")
    for _ in range(2):
        got = sorted((r["doc_id"], r["class_id"], r["n_copies"]) for r in rows_of(neardups.near_duplicates(df)))
        assert got == [(1, 1, 1), (1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_hot_class_is_met_by_broadcast(spark):
    rows = [(i, "one two three four five six" if i % 2 else f"a{i} b{i} c{i} d{i} e{i}") for i in range(400)] + [(None, "x")] * 30 + [(1000 + i, "") for i in range(30)]
    got = rows_of(neardups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert len(got) == 460 and sum(r["n_copies"] == 200 and r["class_id"] == 1 for r in got) == 200


def test_language_equals_brute_force(docs):
    """Predictions, scores and entropies from phrases counted one text at a time."""
    refs = language.references(docs.filter(~language.held_out(5, 0)))
    assert len(refs) > 1 and all("  " not in t for t in refs.values())
    automata = {k: language.SuffixAutomaton(t) for k, t in sorted(refs.items())}
    for r in rows_of(language.identify(docs, refs)):
        text = language.normal(bytes(r["text"]).decode())
        letters = sum(map(str.isalpha, text))
        if not letters:
            assert (r["lang_pred"], r["score"], r["bits"]) == ("und", 0.0, 0.0)
            continue
        bits = {k: sum(a.phrases(text[i : i + language.PIECE]) for i in range(0, len(text), language.PIECE)) * math.log2(len(refs[k])) / letters for k, a in automata.items()}
        best = min(sorted(bits), key=bits.get)
        rest = min(v for k, v in bits.items() if k != best)
        assert r["lang_pred"] == best and math.isclose(r["score"], rest / (bits[best] + rest)) and math.isclose(r["bits"], bits[best])


def test_packing_with_clashing_columns(spark):
    rows = [(i, 0, 700 + i % 5, i, i, i, "x", 1, 2) for i in range(40)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, salt int, before int, rank int, kept string, n int, k0 int")
    got = rows_of(packing.pack(pieces))
    assert len(got) == 40 and all(r["salt"] == r["before"] == r["rank"] == r["doc_id"] and r["kept"] == "x" and r["k0"] == 2 for r in got)

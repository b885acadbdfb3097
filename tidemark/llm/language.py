"""Language identification by cross-parsing entropy.

Each language's reference is the running text of a bounded sample of labelled documents, in a suffix automaton. Text is lower-cased and
every run of other characters than letters becomes one space. A text is parsed against each reference into longest matches, which may span
words; at every PIECE letters a new match begins, so that a task parses many pieces side by side, one character of each at a step. Phrases times log2 of the reference's
length, by letters of the text, is the cross-parsing entropy; the language with the lowest wins, the first by name on ties.

The sample is bounded by two parameters: about `sample_docs` documents a language (never over four times as many), chosen by a hash of doc_id, of rows without one by a hash of the text, and
`sample_letters` characters of all languages together, an equal share for each: documents are taken whole in the order of their hashes until the share is used up, the last one in part. So rows
of one doc_id, rows without any, and labelled texts of any length leave the driver and the automata bounded. Rows that are repeated count once. Prediction reads the whole text and only the text.
Null text, or text without a letter, or no labelled document at all, gives `und` with score 0. Repeated rows each get a prediction. Other columns pass through in `rest`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import by_bytes, identity, only, ship, trimmed

SAMPLE_DOCS, SAMPLE_LETTERS, PIECE, TARGET = 16, 1 << 20, 2048, 25


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def normal(text: str) -> str:
    """Lower-cased letters, with one space before and after each run of them."""
    return " ".join(["", *"".join(c if c.isalpha() else " " for c in text.lower()).split(), ""]) if text else " "


class SuffixAutomaton:
    """All substrings of a text: walking from state 0 succeeds exactly along them."""

    def __init__(self, text: str):
        self.size = len(text)
        links, lengths = [-1], [0]
        nexts: list[dict[str, int]] = [{}]
        last = 0
        for c in text:
            state = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = state
                p = links[p]
            if p >= 0:
                q = nexts[p][c]
                if lengths[p] + 1 == lengths[q]:
                    links[state] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = links[p]
                    links[q] = links[state] = copy
            last = state
        self.nexts = nexts

    def phrases(self, text: str) -> int:
        """Longest matches that the text falls into, from left to right; a character never seen is one alone."""
        nexts, n, i, count = self.nexts, len(text), 0, 0
        while i < n:
            state, start = 0, i
            while i < n and (state := nexts[state].get(text[i], -1)) >= 0:
                i += 1
            if i == start:
                i += 1
            count += 1
        return count


class Parser:
    """Phrase counts of texts against each language's reference, many texts at a time.

    The automata's transitions are in one hash table, keyed by state and character, whatever the alphabet.
    """

    def __init__(self, references: dict[str, str]):
        self.langs = sorted(references)
        letters = sorted({c for x in references.values() for c in x})
        self.code = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width, self.roots, keys, targets, first = len(letters) + 1, [], [], [], 0
        number = {c: i for i, c in enumerate(letters, 1)}
        self.space = number.get(" ", 0)
        self.begin = np.zeros((len(self.langs), self.width), np.int64)
        self.weight = np.array([math.log2(max(len(references[x]), 2)) for x in self.langs])
        for k, lang in enumerate(self.langs):
            nexts = SuffixAutomaton(references[lang]).nexts
            self.roots.append(first)
            self.begin[k] = first
            for c, to in nexts[0].items():
                self.begin[k, number[c]] = first + to
            keys.append(np.fromiter(((first + at) * self.width + number[c] for at, own in enumerate(nexts) for c in own), np.int64))
            targets.append(np.fromiter((first + to for own in nexts for to in own.values()), np.int64))
            first += len(nexts)
        self._fill(np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *targets]))

    def _fill(self, keys: np.ndarray, targets: np.ndarray) -> None:
        """Each key is in one of its two slots, with a state in its low TARGET bits; -1 is a free slot."""
        if len(keys) and (keys.max() >> 63 - TARGET or targets.max() >> TARGET):
            raise ValueError("the sample of labelled documents is too large for an automaton")
        bits = max(4, int(2 * len(keys)).bit_length())
        while True:
            self.shift = np.uint64(64 - bits)
            self.slots = np.full(1 << bits, -1, np.int64)
            held = keys << TARGET | targets
            slot = self._slot(keys, 0)
            for _ in range(500):
                if not len(held):
                    return
                old = self.slots[slot]
                self.slots[slot] = held
                put = self.slots[slot] == held
                # What was there, and what another one took the slot from, goes to its other slot.
                gone = put & (old != -1)
                held, at = np.concatenate([old[gone], held[~put]]), np.concatenate([slot[gone], slot[~put]])
                slot = self._slot(held >> TARGET, 0) ^ self._slot(held >> TARGET, 1) ^ at
            bits += 1

    def _slot(self, keys: np.ndarray, which: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[which])) >> self.shift).astype(np.int64)

    def _step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The state after one more character, -1 where there is none."""
        keys = states * self.width + codes
        out = self.slots[self._slot(keys, 0)]
        other = np.flatnonzero(out >> TARGET != keys)
        held = self.slots[self._slot(keys[other], 1)]
        held[held >> TARGET != keys[other]] = -1
        out[other] = held
        return np.where(out < 0, -1, out & ((1 << TARGET) - 1))

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The normal forms of texts as codes, one after another, their sizes, and how many letters each has."""
        joined = np.frombuffer("".join([f" {t.lower()} " for t in texts]).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(t.lower()) + 2 for t in texts], np.int64)
        firsts = np.cumsum(sizes) - sizes
        letter = _letters()[joined]
        kept = letter | np.append(True, letter[:-1])
        kept[firsts] = True
        codes = np.where(letter, self.code[np.minimum(joined, len(self.code) - 1)], self.space)[kept]
        return codes, np.add.reduceat(kept.astype(np.int64), firsts), np.add.reduceat(letter.astype(np.int64), firsts)

    def phrases(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Longest matches that each text (a row) falls into against each reference (a column); a character never seen is one alone."""
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = (np.cumsum(sizes) - sizes)[owner] + within * PIECE
        length = np.minimum(sizes[owner] - within * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        owner, start, length = owner[order], start[order], length[order]
        live = np.searchsorted(-length, -np.arange(1, PIECE + 1), side="right")  # pieces of at least so many letters
        n = len(self.langs)
        root = np.tile(np.array(self.roots, np.int64), len(start))
        lang = np.tile(np.arange(n), len(start))
        states, counts = root.copy(), np.zeros(len(root), np.int64)
        for k in range(int(length[0]) if len(length) else 0):
            m = int(live[k]) * n
            now, code = states[:m], np.repeat(codes[start[: live[k]] + k], n)
            after = self._step(now, code)
            dead = after < 0
            counts[:m] += dead | (now == root[:m])
            at = np.flatnonzero(dead)
            after[at] = self.begin[lang[at], code[at]]
            states[:m] = after
        out = np.zeros((len(sizes), n), np.int64)
        np.add.at(out, owner, counts.reshape(-1, n))
        return out

    def predict_all(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """For each text the language, the score and the entropy a letter (`und`, 0 and 0 where there is nothing to tell)."""
        said, score, bits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        if not texts or not self.langs:
            return said, score, bits
        codes, sizes, letters = self.coded(texts)
        entropy = self.phrases(codes, sizes) * self.weight / np.maximum(letters, 1)[:, None]
        rows, best = np.arange(len(texts)), np.argmin(entropy, axis=1)
        least = entropy[rows, best]
        entropy[rows, best] = np.inf
        some = letters > 0
        rest = entropy.min(axis=1)
        score[some] = (rest / (least + rest))[some] if len(self.langs) > 1 else 1.0
        bits[some] = least[some]
        return [self.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], score, bits

    def predict(self, text: str) -> tuple[str, float]:
        said, score, _ = self.predict_all([text])
        return said[0], float(score[0])


def references(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_letters: int = SAMPLE_LETTERS) -> dict[str, str]:
    """A reference text for each language of labelled documents (doc_id, text, lang), from the bounded sample."""
    known = labelled.filter("lang is not null and text is not null").select("lang", "doc_id", "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(float(sample_docs / n)))])
    own = F.xxhash64(F.lit(3), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
    place = F.pmod(own, F.lit(1 << 30)) / float(1 << 30)
    share = max(1, sample_letters // len(counts))
    chosen = known.withColumn("place", place).filter(F.col("place") < rate[F.col("lang")]).withColumn("text", F.substring("text", 1, share)).dropDuplicates(["lang", "doc_id", "text"])
    first = chosen.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("place", "doc_id", "text"))).filter(F.col("rank") <= 4 * sample_docs)
    left = dict.fromkeys(counts, share)
    out: dict[str, list[tuple]] = {k: [] for k in counts}
    # One at a time, in order: what is beyond a language's share is not kept.
    for r in first.orderBy("lang", "rank").toLocalIterator():
        text = r["text"][: left[r["lang"]]]
        left[r["lang"]] -= len(text)
        out[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, text))
    made = {k: "".join(normal(t) for *_, t in sorted(v)).replace("  ", " ") for k, v in out.items()}
    return {k: t for k, t in made.items() if any(map(str.isalpha, t))}


def alphabet(labelled: DataFrame) -> str:
    """Every letter, lower-cased, of every labelled text, in order; there are at most as many as code points."""
    ship(labelled.sparkSession)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0x110000, bool)
        for batch in (part for whole in batches for part in by_bytes(whole)):
            found[np.frombuffer("".join(t.decode().lower() for t in batch.column("text").to_pylist()).encode("utf-32-le"), "<u4")] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found & _letters()))], ["code"])

    known = identity(labelled.filter("lang is not null and text is not null").select("doc_id", "text")).select("text")
    return "".join(chr(r["code"]) for r in known.mapInArrow(seen, "code long").distinct().orderBy("code").collect())


def identify(docs: DataFrame, references: dict[str, str], letters: str | None = None) -> DataFrame:
    """doc_id, rest (struct of the other columns), text, lang_pred, score, bits (entropy a letter), n_known (letters of the text that are among `letters`; None: all are)."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((references, letters))
    key = hash((tuple(sorted(references.items())), letters))

    def model() -> tuple[Parser, np.ndarray]:
        known = np.zeros(0x110000, bool)
        known[[ord(c) for c in held.value[1] or ""]] = True
        return Parser(held.value[0]), _letters() if held.value[1] is None else known

    def count(texts: list[str], known: np.ndarray) -> np.ndarray:
        hit = known[np.frombuffer("".join([t + " " for t in texts]).encode("utf-32-le"), "<u4")]
        ends = np.cumsum([len(t) + 1 for t in texts])
        return np.diff(np.append(0, np.cumsum(hit)[ends - 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, known = only(("parser", key), model)
        for batch in (part for whole in trimmed(batches) for part in by_bytes(whole)):
            texts = [(t or b"").decode() for t in batch.column("text").to_pylist()]
            said, score, bits = parser.predict_all(texts)
            made = [pa.array(said, pa.string()), pa.array(score), pa.array(bits), pa.array(count([t.lower() for t in texts], known), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "lang_pred", "score", "bits", "n_known"])

    rows = identity(docs)
    kind = rows.schema["rest"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id long, text binary, rest {kind}, lang_pred string, score double, bits double, n_known long")


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves `fold`; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))

"""SentencePiece encoding and decoding with a merge-type (BPE) model.

A text is encoded exactly, without running its merges: an Aho-Corasick automaton over the reachable pieces
gives the longest piece that starts at each position; pieces are taken from left to right, each checked against
its left neighbour by re-merging the two (a sequence is the encoding exactly if every adjacent pair encodes to
itself); where no piece fits, the last one is given up, and a bitfield remembers positions that were left so.
If no piece has the space mark after another character, the marks cut the text into parts that encode alone,
a part is cut between all characters that are side by side in no piece, and a task keeps the parts that it has seen; characters that no piece holds become their UTF-8 bytes.

Null and empty texts encode to begin and end alone and decode to the empty text. A text of one unbroken part is
encoded in time linear in its length.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import by_bytes, identity, only, ship

MARK = "▁"
#: Parts and pairs that a task keeps at most; beyond that it starts anew.
KEPT = 800_000


def _each_bad_byte(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("tidemark-each", _each_bad_byte)


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        lib = SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        skip = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        self.byte_ids = [0] * 256
        self.pieces: list[str] = []
        self.raw: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            self.pieces.append(piece)
            if lib.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif skip[i]:
                self.raw.append(" ⁇ ".encode() if lib.is_unknown(i) else b"")
            else:
                self.raw.append(piece.replace(MARK, " ").encode())
                self.ids[piece] = i
                self.score[piece] = lib.get_score(i)
        self.quiet = {i for i in range(n) if lib.is_control(i)}
        chars = {c for p in self.ids for c in p}
        self.known = {c for c in chars if c in self.ids}
        alone = all(MARK not in p.lstrip(MARK) for p in self.ids)
        inner = "".join(re.escape(c) for c in sorted(self.known - {MARK}))
        self.cut = re.compile(f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]" if alone and inner else f"[{inner}{MARK}]+|[^{inner}{MARK}]")
        self.automaton = ahocorasick.Automaton()
        self.reachable = set()
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.merge(piece) == [piece]:
                self.reachable.add(piece)
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        #: Characters side by side in some piece; no merge spans any other two.
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.length = [len(p) for p in self.pieces]
        self.shorter = [-1] * n
        for piece in self.reachable:
            for k in range(len(piece) - 1, 0, -1):
                if piece[:k] in self.reachable:
                    self.shorter[self.ids[piece]] = self.ids[piece[:k]]
                    break
        self.pairs: dict[int, bool] = {}
        self.parts = _Parts(self)

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging: again and again the best-scored adjacent pair, the leftmost of equals."""
        at = list(text)
        while True:
            best, where = None, -1
            for i in range(len(at) - 1):
                s = self.score.get(at[i] + at[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                return at
            at[where : where + 2] = [at[where] + at[where + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, side by side, encode to themselves."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.pairs[key] = self.merge(a + b) == [a, b]
        return known

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part whose characters are all pieces, or of one character that is none."""
        if part in self.reachable:
            return [self.ids[part]]
        if part[0] not in self.known:
            return [self.byte_ids[b] for b in part.encode()]
        n = len(part)
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(part):  # ends ascend, so the longest from a start comes last
            longest[end - size + 1] = i
        failed = bytearray((n >> 3) + 1)
        taken: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + self.length[token]
            if not failed[end >> 3] >> (end & 7) & 1 and (not taken or self.compatible(taken[-1], token)):
                taken.append(token)
                pos = end
                token = longest[pos] if pos < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                token = taken.pop()
                pos -= self.length[token]
        return taken

    def encode(self, text: str) -> bytes:
        """Ids with begin and end, as little-endian unsigned 32-bit integers."""
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        if not text:
            return ends
        parts = self.cut.findall(MARK + text.replace(" ", MARK))
        if len(self.parts) >= KEPT:
            self.parts.clear()
        return b"".join([ends[:4], *map(self.parts.__getitem__, parts), ends[4:]])

    def decode(self, ids: bytes) -> str:
        """The text of ids; begin, end and the mark put before the text are left out."""
        each = [i for i in np.frombuffer(ids, "<u4").tolist() if i not in self.quiet]
        text = b"".join(map(self.raw.__getitem__, each))
        if each and self.pieces[each[0]].startswith(MARK):
            text = text[1:]
        return text.decode("utf-8", "tidemark-each")


class _Parts(dict):
    """Ids of parts, as bytes, made when first asked for."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, part: str) -> bytes:
        near = self.model.neighbours
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in near]
        if cuts:
            # What lies between two cuts has none itself, so this is one call deep.
            made = b"".join([self[part[a:b]] for a, b in zip([0, *cuts], [*cuts, len(part)])])
        else:
            ids = self.model.encode_part(part)
            made = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64:
            self[part] = made
        return made


def model(path: str) -> PieceModel:
    return only(("pieces", path), lambda: PieceModel(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, with begin and end), decoded (text), in the rows' own partitions."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for part in by_bytes(batch):
                ids = [m.encode(t.decode()) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(map(m.decode, ids), pa.string())], ["doc_id", "ids", "decoded"]
                )

    return identity(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded string")

"""Words of whole texts as numpy arrays, for use inside tasks.

A word is a maximal run of bytes other than space and 0x09-0x0D in the UTF-8 text, which is what
`bytes.split()` gives. A word's hash mixes in eight of its bytes at a time (the words of a batch side by side), a long word's is of
its BLAKE2b digest; the hash of a sequence of words mixes theirs pairwise, in about log2(width) steps. Shifts between the
multiplications keep both from being polynomials, which chosen words could make collide.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 18
#: Bytes of a word that are mixed in; a longer word goes by its digest.
_LONG = 256
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seeds: int) -> list[np.ndarray]:
    """For each of `seeds` independent hashes, the values of the byte spans [start, end); eight bytes must follow the last."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    out = [(size + 1).astype(np.uint64) * np.uint64(_SEEDS[s]) for s in range(seeds)]
    live, at = np.arange(len(starts)), 0
    while len(live) and at < _LONG:
        left = size[live] - at
        eight = eights[starts[live] + at] & _FIRST[np.minimum(left, 8)]
        for x in out:
            x[live] = _joined(x[live], eight)
        live = live[left > 8]
        at += 8
    for i in live.tolist():
        digest = blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        for s, x in enumerate(out):
            x[i] = int.from_bytes(digest[8 * s : 8 * s + 8], "little")
    return [mix(x) for x in out]


def word_hashes(texts: list[bytes], seeds: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words in each text, and for each of `seeds` (one or two) independent hashes the values of all words in order."""
    counts: list[np.ndarray] = []
    out: list[list[np.ndarray]] = [[] for _ in range(seeds)]
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) < _CHUNK):
            size += len(texts[upto]) + 1
            upto += 1
        part = texts[at:upto]
        at = upto
        data = b" ".join(part) + b"         "
        space = np.ones(len(data) + 1, np.int8)
        space[1:] = _SPACE[np.frombuffer(data, np.uint8)]
        edge = np.diff(space)
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        bounds = np.zeros(len(part) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in part], out=bounds[1:])
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        for s, h in enumerate(span_hashes(data, starts, ends, seeds)):
            out[s].append(h)
    if not counts:
        return np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in range(seeds)]
    return np.concatenate(counts).astype(np.int64), [np.concatenate(x) for x in out]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence from those of its beginning and its end."""
    x = a * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(31)
    return x


def sequence_hashes(words: np.ndarray, counts: np.ndarray, width: int, short: bool = False, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of each run of `width` words in each text.

    A text with fewer words gives nothing, or with `short` one run of all its words (none if it has no word).
    Texts are taken about `_CHUNK` words at a time, so what is held besides the result stays small.
    """
    ends = np.cumsum(counts)
    values, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    at = 0
    while at < len(counts):
        begin = int(ends[at] - counts[at])
        upto = max(at + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
        value, doc, place = _runs(words[begin : ends[upto - 1]], counts[at:upto], width, short, seed)
        values.append(value)
        docs.append((doc + at).astype(np.int32))
        places.append(place.astype(np.int32))
        at = upto
    return np.concatenate(values), np.concatenate(docs), np.concatenate(places)


def _runs(words: np.ndarray, counts: np.ndarray, width: int, short: bool, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(words)
    ends = np.cumsum(counts)
    firsts = ends - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(n)
    full = start + width <= ends[doc]
    value = np.zeros(n, np.uint64)
    x = words + np.uint64(_SEEDS[seed])
    if n >= width:
        done, whole = 1, x
        while done < width:
            step = min(done, width - done)
            whole = _joined(whole[:-step], whole[step:])
            done += step
        value[: n - width + 1] = whole
    if short:
        few = np.flatnonzero((counts > 0) & (counts < width))
        at = x[firsts[few]]
        for k in range(1, width - 1):
            more = counts[few] > k
            at[more] = _joined(at[more], x[firsts[few[more]] + k])
        value[firsts[few]] = mix(at + counts[few].astype(np.uint64))
        full[firsts[few]] = True
    return value[full], doc[full], (start - firsts[doc])[full]


def as_bytes(column) -> list[bytes]:
    """An Arrow column of binary or text as bytes; null becomes empty."""
    return [b"" if x is None else x if isinstance(x, bytes) else x.encode() for x in column.to_pylist()]

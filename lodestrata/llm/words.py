"""Words of many texts at once, as arrays: where they are, their hashes, and runs of them.

A word's hash is a polynomial over its bytes' values, taken as a difference of prefix sums over a piece of bytes.
"""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time; longer words are hashed alone.
_PIECE = 1 << 17

IN_WORD = np.array([i not in b" \t\n\v\f\r" for i in range(256)])
#: Values of the bytes as they are, and with A-Z lower-cased.
EXACT = np.array([xxhash.xxh3_64_intdigest(bytes([i])) for i in range(256)], dtype=np.uint64)
LOWER = np.array([xxhash.xxh3_64_intdigest(bytes([i]).lower()) for i in range(256)], dtype=np.uint64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray = EXACT) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends], in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + _PIECE, side="right"))
        if j <= i:
            word = data[lo : ends[i]].tobytes()
            out[i] = xxhash.xxh3_64_intdigest(word.lower() if letters is LOWER else word)
            i += 1
            continue
        piece = data[lo : ends[j - 1]]
        sums = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(letters[piece] * _UP[: len(piece)], out=sums[1:])
        s = starts[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * _DOWN[s]
        i = j
    return mix(out)


def canonical(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``data, starts, ends, n``: all words of the texts with one space after each, their places, and each text's number."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = IN_WORD[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    n = np.diff(np.searchsorted(np.flatnonzero(first), cuts), prepend=0)
    first, inside, data = first[keep], inside[keep], data[keep]
    data[~inside] = 0x20
    starts = np.flatnonzero(first)
    return data, starts, np.flatnonzero(~inside), n

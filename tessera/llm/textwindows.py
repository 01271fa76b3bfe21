"""Words of a batch of texts and 64-bit hashes of their word windows, in numpy.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``, the same as
``[^\\x20\\x09-\\x0D]+`` on the decoded text, because no byte of a longer UTF-8
sequence lies in that range. All hashes depend on the bytes alone, so that every
executor, Python build and run gives the same values.
"""

from __future__ import annotations

import numpy as np

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_STEP = 1 << 20  # bytes hashed at a time, so that powers stay in a small table


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0xD6E8FEB86659FD93
_UP = _powers(_BASE, _STEP + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _STEP + 1)


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array."""
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(_IS_SPACE[data], out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A hash of each word: its bytes' values as a polynomial modulo 2**64, mixed with its length."""
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(seed)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + _STEP, "right"))
        if j <= i:  # one word longer than a step
            total, scale = np.uint64(0), np.uint64(1)
            with np.errstate(over="ignore"):
                for k in range(at, int(ends[i]), _STEP):
                    part = values[data[k : min(k + _STEP, int(ends[i]))]]
                    total += (part * _UP[: len(part)]).sum(dtype=np.uint64) * scale
                    scale *= _UP[_STEP]
            out[i] = total
            i += 1
            continue
        part = values[data[at : int(ends[j - 1])]]
        part *= _UP[: len(part)]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(part, out=sums[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * _DOWN[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * _ODD)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two adjoining (or overlapping) windows from theirs; the order counts."""
    return mix(left * _M2 + right + _ODD)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` words, doubling from single words.

    A window of a length that is no power of two is that of two overlapping
    halves. One entry for each start; empty if there are fewer words.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, size = words, 1
    while size * 2 <= length:
        have = joined(have[: len(have) - size], have[size:])
        size *= 2
    if size < length:
        have = joined(have[:n], have[length - size : length - size + n])
    return have


class Batch:
    """Words of many texts laid end to end: ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: list[bytes], seed: int = 1, lower: bool = False):
        self.data = b"\n".join(texts)
        if lower:
            self.data = self.data.lower()  # bytes.lower() touches A-Z alone
        view = np.frombuffer(self.data, np.uint8)
        self.starts, self.ends = word_bounds(view)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(self.starts, self.begin)
        self.view = view
        self.hashes = word_hashes(view, self.starts, self.ends, seed)

    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def words(self, i: int) -> list[bytes]:
        return self.data[self.begin[i] : max(self.begin[i], self.begin[i + 1] - 1)].split()

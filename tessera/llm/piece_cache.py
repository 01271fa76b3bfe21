"""Ids of recurring pieces of text, looked up for a whole batch in sorted numpy arrays.

A piece is known by two hashes of its bytes, so the cache keeps neither strings nor
Python objects: about 25 bytes for each piece, in two halves of bounded size. When
the younger half is full the older one goes, and pieces met again move over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from tessera.llm.textwindows import mix, word_hashes

LONG = 512  # bytes from which a piece is named by a cryptographic hash
KEPT_IDS = 255  # a piece of more ids is not kept


def ragged(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``pool[at[i]:at[i] + n[i]]`` for all i, end to end."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(at - (ends - n), n) + np.arange(total)]


def piece_names(view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each piece."""
    names, checks = word_hashes(view, starts, ends, 1), word_hashes(view, starts, ends, 2)
    for i in np.flatnonzero(ends - starts > LONG):
        both = hashlib.blake2b(view[starts[i]:ends[i]].tobytes(), digest_size=16).digest()
        names[i], checks[i] = np.frombuffer(both, "<u8")
    return names, checks


class _Half:
    """Sorted names with checks and the ids of each."""

    def __init__(self, kind: type):
        self.names, self.checks = np.empty(0, np.uint64), np.empty(0, np.uint32)
        self.at, self.n = np.empty(0, np.uint32), np.empty(0, np.uint8)
        self.pool = np.empty(0, kind)

    def bytes(self) -> int:
        return 17 * len(self.names) + self.pool.nbytes

    def find(self, names: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``names`` are here, and where."""
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        where = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return (self.names[where] == names) & (self.checks[where] == checks.astype(np.uint32)), where

    def add(self, names: np.ndarray, checks: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Adds sorted ``names`` that are not here."""
        where = np.searchsorted(self.names, names)
        at = len(self.pool) + np.cumsum(n) - n
        self.names, self.checks = np.insert(self.names, where, names), np.insert(self.checks, where, checks.astype(np.uint32))
        self.at, self.n = np.insert(self.at, where, at.astype(np.uint32)), np.insert(self.n, where, n.astype(np.uint8))
        self.pool = np.concatenate([self.pool, ids.astype(self.pool.dtype)])


class PieceCache:
    """``cache(names, checks, learn)``: ids of all pieces end to end, and how many each has."""

    def __init__(self, vocabulary: int, most_bytes: int = 48 << 20):
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.most = most_bytes
        self.young, self.old = _Half(self.kind), _Half(self.kind)

    def __call__(self, names: np.ndarray, checks: np.ndarray, learn: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """``learn`` gets places of pieces that are not known and returns the ids of each."""
        distinct, first, of = np.unique(names, return_index=True, return_inverse=True)
        torn = checks[first][of] != checks
        if torn.any():  # two pieces of one name: both hashes together name them in this batch
            twice = np.isin(names, names[torn])
            return self(np.where(twice, mix(names ^ mix(checks)), names), checks, learn)
        if 2 * self.young.bytes() > self.most:
            self.young, self.old = _Half(self.kind), self.young
        check = checks[first]
        at, n = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        pools, size = [], 0
        open_ = np.arange(len(distinct))
        for half in (self.young, self.old):
            here, where = half.find(distinct[open_], check[open_])
            got, where = open_[here], where[here]
            n[got] = half.n[where]
            pools.append(ragged(half.pool, half.at[where].astype(np.int64), n[got]))
            at[got] = size + np.cumsum(n[got]) - n[got]
            size += len(pools[-1])
            if half is self.old:
                moved = got
            open_ = open_[~here]
        if len(open_):
            ids = learn(first[open_])
            n[open_] = np.fromiter(map(len, ids), np.int64, len(ids))
            pools.append(np.fromiter((i for some in ids for i in some), self.kind, int(n[open_].sum())))
            at[open_] = size + np.cumsum(n[open_]) - n[open_]
        pool = np.concatenate(pools)
        new = np.sort(np.concatenate([moved, open_]))
        new = new[n[new] <= KEPT_IDS]
        if len(new):
            self.young.add(distinct[new], check[new], n[new], ragged(pool, at[new], n[new]))
        return ragged(pool, at[of], n[of]), n[of]

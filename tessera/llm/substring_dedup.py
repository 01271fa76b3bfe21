"""Substring removal by level-wise doubling.

A run of ``length`` words that repeats holds shorter runs that repeat. Windows
of a quarter of the length are looked at first, then those of half, then whole
ones: of every window that is still a candidate the half-length run with the
smallest hash (its anchor) is asked for, and the window lives on, at twice the
anchor's length, only if another document has that anchor too. Equal windows
have equal anchors, so no repeat is lost, and a fifth of all positions is asked
for on the first level, ever fewer later. On the last level the window itself is
asked for, with 96 bits of hash; words of windows that start in a document with
a smaller id too are removed. The search ends early when no candidate survives.

Windows are those of the input, not of what is left. Defined cases: null and
empty texts have no words; a text shorter than the length keeps all; equal ids
are not smaller than each other, so rows with one id don't remove each other's
words; a null id is larger than all others; an empty input gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import NO_ID, SENT, parts_for, sent, told, unpack, with_answers, write_blocks
from tessera.llm.textwindows import Batch, mix, window_hashes

KEYS_PER_BYTE = 0.04  # anchors of the first level for each byte of text, about


def levels_of(length: int) -> list[int]:
    """Lengths that double up to ``length``: 4, 8, 13 for 13."""
    out = [length]
    size = 4
    while size < length:
        out.insert(-1, size)
        size *= 2
    return out


def _anchors(hashes: np.ndarray, size: int, length: int, n: int) -> np.ndarray:
    """For each of ``n`` windows the place of the run of ``size`` words in it with the smallest hash (the first of equals)."""
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, length - size + 1):
        less = hashes[k:k + n] < best
        best[less] = hashes[k:k + n][less]
        at[less] = k
    return at + np.arange(n)


class _Windows:
    """Windows of one block and which of them are still candidates."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], length: int):
        self.batch, self.length, self.ids = Batch(texts), length, ids
        words = self.batch.n_words()
        self.row = np.repeat(np.arange(len(texts)), words)
        self.n = max(0, len(self.row) - length + 1)
        self.alive = self.row[:self.n] == self.row[length - 1:] if self.n else np.zeros(0, bool)

    def anchors(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the candidates' anchors, which of them several of the block's documents have, and each candidate's key."""
        hashes = window_hashes(self.batch.hashes, size)
        live = np.flatnonzero(self.alive)
        at = _anchors(hashes, size, self.length, self.n)[live] if self.n else np.zeros(0, np.int64)
        places, of = np.unique(at, return_inverse=True)
        keys, key_of = np.unique(hashes[places], return_inverse=True)
        row = self.row[places]
        low, high = np.full(len(keys), len(self.ids)), np.full(len(keys), -1)
        np.minimum.at(low, key_of, row)
        np.maximum.at(high, key_of, row)
        return keys, low < high, key_of[of]

    def whole(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys and checks of the candidate windows, their smallest id here, and each candidate's key."""
        live = np.flatnonzero(self.alive)
        hashes = window_hashes(self.batch.hashes, self.length)[live]
        checks = window_hashes(mix(self.batch.hashes + np.uint64(77)), self.length)[live] >> np.uint64(32)
        order = np.lexsort((self.ids[self.row[live]], checks, hashes))
        k, c, i = hashes[order], checks[order], self.ids[self.row[live]][order]
        first = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]) if len(k) else np.zeros(0, bool)
        key_of = np.empty(len(k), np.int64)
        key_of[order] = np.cumsum(first) - 1
        return k[first], c[first].astype("<u4"), i[first], key_of

    def survive(self, size: int, bits: dict[int, bytes], parts: int) -> None:
        keys, here, of = self.anchors(size)
        repeated = here | unpack(bits, keys, parts)
        self.alive[np.flatnonzero(self.alive)[~repeated[of]]] = False


def remove_repeats(docs: DataFrame, length: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text, words joined by one space) of every document."""
    blocks = write_blocks(docs)
    parts = parts_for(blocks, KEYS_PER_BYTE)
    lengths = levels_of(length)
    answers: DataFrame | None = None
    for level, size in enumerate(lengths):
        def ask(block, ids, texts, by, level=level, size=size):
            windows = _Windows(ids, texts, length)
            for k in range(level):
                windows.survive(lengths[k], by.get(k, {}), parts)
            if level < len(lengths) - 1:
                return sent(block, windows.anchors(size)[0], parts)
            keys, checks, least, _ = windows.whole()
            return sent(block, keys, parts, checks, least)

        new = told(with_answers(blocks, answers, ask, SENT), level)
        answers = new if answers is None else answers.unionByName(new)
        if level < len(lengths) - 1 and new.isEmpty():
            break

    def finish(block, ids, texts, by):
        windows = _Windows(ids, texts, length)
        for k in range(len(lengths) - 1):
            windows.survive(lengths[k], by.get(k, {}), parts)
        keys, _, least, of = windows.whole()
        live = np.flatnonzero(windows.alive)
        elsewhere = unpack(by.get(len(lengths) - 1, {}), keys, parts)
        gone = live[elsewhere[of] | (least[of] < ids[windows.row[live]])] if len(live) else live
        edges = np.zeros(len(windows.row) + length + 1, np.int32)
        np.add.at(edges, gone, 1)
        np.add.at(edges, gone + length, -1)
        keep = np.cumsum(edges)[:len(windows.row)] == 0
        first = windows.batch.first
        for i in range(len(texts)):
            words, mine = texts[i].split(), keep[first[i]:first[i + 1]]
            n = len(words)
            if not mine.all():
                words = list(compress(words, mine.tolist()))
            kept = b" ".join(words)
            row = (None if ids[i] == NO_ID else int(ids[i]), n, n - len(words), hashlib.sha256(kept).hexdigest())
            yield row + ((kept.decode("utf-8", "replace"),) if with_text else ())

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    return with_answers(blocks, answers, finish, schema).withColumn("doc_id", F.col("doc_id").cast("long"))

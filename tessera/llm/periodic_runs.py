"""Periodic runs of words, by match lengths on sparse diagonals.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal), at least ``least`` and 2 q words long, that no neighbouring word extends. Words
i - q and i that are equal lie on the diagonal of lag q; a run of period q is a
match of length - q words on that diagonal. Every earlier occurrence of what stands
at a place lengthens the match on its diagonal; a match that ends gives its run if it
is long enough.

A frequent word would make the square of its count in matches. So the occurrences
are those of blocks: a match that is long enough for lag q covers a whole aligned block
of b words wherever b is at most half of what it needs, and only lags from 2 b to
4 b are asked of blocks of b words. Blocks of 3, 6, 12, ... words take all lags; each
level makes at most about two matches for each word, whatever the text. Matches of
neighbouring blocks on a diagonal are one match, whose ends are then found word by
word. Blocks are named exactly, by ranks of pairs of halves, and a level is worked out
only for places whose halves both recur.

Words are maximal strings of bytes other than ``\\x20`` and ``\\x09`` to ``\\x0D``. Texts are
taken whole, many short ones in one pass; a text is never cut, so a task holds one
whole text at least. Multiples of a run's period give the same stretch and are left out.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text;
keys may repeat or be null, each row stands for itself; an empty input gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_a_time

GROUP = 200_000  # words taken in one pass
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _recurring(places: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose name occurs twice or more, with dense names in order of the old ones."""
    order = np.argsort(names, kind="stable")
    sorted_ = names[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])[:len(sorted_)]
    of = np.cumsum(new) - 1
    twice = np.bincount(of)[of] > 1 if len(of) else np.zeros(0, bool)
    kept = order[twice]
    dense = np.cumsum(new & twice) - 1
    back = np.argsort(kept, kind="stable")
    return places[kept[back]], dense[twice][back]


def _wider(places: np.ndarray, names: np.ndarray, width: int, to: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From windows of ``width`` words to windows of ``to``, at most twice as many; only those that recur stay."""
    at = np.full(n, -1, np.int64)
    at[places] = names
    here = places[places + to <= n]
    right = at[here + to - width]
    here, right = here[right >= 0], right[right >= 0]
    return _recurring(here, at[here] * (names.max(initial=0) + 1) + right)


def _matches(places: np.ndarray, names: np.ndarray, block: int, low: int, high: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned blocks and the lags, from ``low`` up to ``high``, of their earlier occurrences."""
    order = np.argsort(names, kind="stable")
    keys = names[order] * n + places[order]
    aligned = places % block == 0
    here, base = places[aligned], names[aligned] * n
    first = np.searchsorted(keys, base + np.maximum(here - high + 1, 0))
    count = np.maximum(np.searchsorted(keys, np.maximum(base + here - low, base - 1), "right") - first, 0)
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    earlier = keys[np.repeat(first - (ends - count), count) + np.arange(ends[-1])] % n
    here = np.repeat(here, count)
    return here, here - earlier


def _extended(words: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int) -> np.ndarray:
    """How many more words, going by ``step`` from ``at`` (itself the first asked), equal those ``lag`` before them."""
    grown = np.zeros(len(at), np.int64)
    open_, width = np.arange(len(at)), 1
    while len(open_):
        place = at[open_, None] + step * (grown[open_, None] + np.arange(width))
        inside = (place < len(words)) & (place - lag[open_, None] >= 0)
        place = np.where(inside, place, lag[open_, None])
        same = inside & (words[place] == words[place - lag[open_, None]])
        run = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        grown[open_] += run
        open_ = open_[run == width]
        width = min(2 * width, max(1, (1 << 20) // max(1, len(open_))))
    return grown


def find_runs(words: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs, by start and period, of numbered words.

    Several texts may stand end to end if their numbers are different; then no run goes across.
    """
    n = len(words)
    block = max(1, ((least + 1) // 2 + 1) // 2)
    covered, over = np.full(n, -1, np.int64), np.zeros(n, np.int64)  # the longest run known over a word, and its length
    runs = np.empty((0, 3), np.int64)
    places, names = _recurring(np.arange(n), words)
    width, low = 1, 1
    while len(places) and 2 * low <= n:
        while width < block and len(places):
            to = min(2 * width, block)
            places, names = _wider(places, names, width, to, n)
            width = to
        if not len(places):
            break
        here, lag = _matches(places, names, block, low, 4 * block, n)
        run = covered[here]  # on multiples of a known run's period the match is that of the run
        known = run >= 0
        s, length, q = runs[run[known]].T
        known[known] = (here[known] - lag[known] >= s) & (here[known] + block <= s + length) & (lag[known] % q == 0)
        here, lag = here[~known], lag[~known]
        order = np.lexsort((here, lag))
        here, lag = here[order], lag[order]
        starts = np.flatnonzero(np.concatenate([[True], (lag[1:] != lag[:-1]) | (here[1:] != here[:-1] + block)])[:len(here)])
        ends = np.append(starts[1:], len(here))[:len(starts)] - 1
        q, begin, end = lag[starts], here[starts], here[ends] + block
        begin = begin - _extended(words, begin - 1, q, -1)
        end = end + _extended(words, end, q, 1)
        begin = begin - q
        long = end - begin >= np.maximum(least, 2 * q)
        new = np.column_stack([begin, end - begin, q])[long]
        new = new[np.lexsort((new[:, 2], new[:, 0], new[:, 1]))]
        if len(new):  # of one stretch the smallest period; those of earlier levels are smaller and were left out above
            new = new[np.concatenate([[True], (new[1:, :2] != new[:-1, :2]).any(axis=1)])]
        for k, (s, length, _) in enumerate(new.tolist(), len(runs)):
            wins = over[s:s + length] < length
            covered[s:s + length][wins] = k
            over[s:s + length][wins] = length
        runs = np.concatenate([runs, new])
        low, block = 4 * block, 2 * block
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    if len(runs):  # a stretch that a longer run hid at a level above
        runs = runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _kept(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which words stay: those not in any run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts + periods, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) == 0


def collapse_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Runs of every whole text and the text without their repeats.

    Returns key, n_words, runs (by start, then period; word numbers from 0) and
    collapsed: the words that stay, joined by one space.
    """

    def found(group: list[list[bytes]]) -> tuple[list, list]:
        numbers: list[int] = []
        firsts = [0]
        for words in group:
            names = dict.fromkeys(words)
            names = dict(zip(names, range(len(numbers), len(numbers) + len(names))))
            numbers += map(names.__getitem__, words)
            firsts.append(len(numbers))
        starts, lengths, periods = find_runs(np.array(numbers, np.int64), least)
        bounds = np.searchsorted(starts, firsts).tolist()
        runs, texts = [], []
        for words, first, a, b in zip(group, firsts, bounds, bounds[1:]):
            at, long, q = starts[a:b] - first, lengths[a:b], periods[a:b]
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in zip(at.tolist(), long.tolist(), q.tolist())])
            texts.append(b" ".join(compress(words, _kept(len(words), at, long, q).tolist()) if b > a else words).decode())
        return runs, texts

    def collapse(batches):
        for batch in few_at_a_time(batches):
            runs, texts, sizes = [], [], []
            group: list[list[bytes]] = []
            held = 0
            for row in batch.column(1):
                group.append((row.as_py() or "").encode().split())
                sizes.append(len(group[-1]))
                held += sizes[-1]
                if held >= GROUP:
                    more = found(group)
                    runs, texts, group, held = runs + more[0], texts + more[1], [], 0
            more = found(group)
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "n_words": pa.array(sizes, pa.int64()),
                                              "runs": pa.array(runs + more[0], _RUN_TYPE), "collapsed": pa.array(texts + more[1], pa.string())})

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(collapse, f"key long, n_words long, runs {RUNS}, collapsed string").withColumnRenamed("key", key)

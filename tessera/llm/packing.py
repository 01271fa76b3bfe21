"""Packing documents into training sequences by non-negative least squares.

A document of n ids is cut into full windows and one shorter rest. Of the rests
only the histogram of lengths counts: shallow combinations of lengths that fill
a window exactly (all pairs, and triples on a grid) are the columns of a matrix,
repeat counts come from non-negative least squares against the histogram, are
rounded and held to what is there, and what remains is packed greedily, the
longest first, again by counts. The plan has a few thousand rows however many
documents there are; Spark numbers the pieces of each length and every piece
looks its place up.

Defined cases: a null text is empty; an empty document is its end id alone and
still a piece; equal rows and equal or null keys are pieces of their own; an
empty input gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_a_time, numbered, persist_table
from tessera.llm.tokens import encoder

GRID = 16  # triples have lengths that are multiples of it


def combinations(window: int, grid: int = GRID) -> list[tuple[int, ...]]:
    """Pairs, and triples on the grid, whose lengths add up to the window."""
    pairs = [(window - a, a) for a in range(1, window // 2 + 1)]
    triples = [(window - a - b, b, a) for a in range(grid, window // 3 + 1, grid) for b in range(a, (window - a) // 2 + 1, grid)]
    return pairs + triples


def least_squares(columns: np.ndarray, target: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Non-negative least squares by coordinate descent on the normal equations."""
    gram, right = columns.T @ columns, columns.T @ target
    x, slope = np.zeros(columns.shape[1]), -right
    size = np.diag(gram)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(x)):
            step = max(0.0, x[j] - slope[j] / size[j]) - x[j]
            if step:
                x[j] += step
                slope += step * gram[:, j]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return x


def packing_plan(histogram: dict[int, int], window: int) -> pd.DataFrame:
    """Where the pieces of each length go.

    Rows: length, lo, hi (numbers of the pieces), each (pieces of this length in
    one sequence), first (sequence id of piece lo), offset.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    rows, used, sequences = [], np.zeros(window + 1, np.int64), 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        at = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            rows.append((length, used[length], used[length] + each * times, each, sequences, at))
            used[length] += each * times
            left[length] -= each * times
            at += each * length
        sequences += times

    if left[window]:
        place([window], int(left[window]))
    mixes = [c for c in combinations(window) if all(left[x] for x in c)]
    if mixes:
        matrix = np.zeros((window + 1, len(mixes)))
        for j, mix in enumerate(mixes):
            for x in mix:
                matrix[x, j] += 1
        counts = least_squares(matrix, left.astype(float))
        for j in np.argsort(-counts, kind="stable"):
            mix = list(mixes[j])
            times = min(int(round(counts[j])), *(int(left[x]) // mix.count(x) for x in mix))
            if times > 0:
                place(mix, times)
    while left.any():  # every turn uses up a length
        mix, room, free = [], window, left.copy()
        while True:
            fits = np.flatnonzero(free[1:room + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            n = min(room // length, int(free[length]))
            mix += [length] * n
            free[length] -= n
            room -= n * length
        place(mix, min(int(left[x]) // mix.count(x) for x in set(mix)))
    return pd.DataFrame(rows, columns=["length", "lo", "hi", "each", "first", "offset"])


def pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """All documents as pieces of at most a window: key, start, length, ids_crc32, doc_tokens (and ids, little-endian)."""
    schema = f"{key} long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in few_at_a_time(batches):
            rows = []
            for k, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at:4 * (at + window)]
                    rows.append((k, at, len(part) // 4, zlib.crc32(part), n) + ((bytes(part),) if with_ids else ()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.binary()) for c in columns[5:]],
                [key, "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(columns)])

    return docs.select(F.col(key).cast("long"), "text").mapInArrow(cut, schema)


def pack(cut: DataFrame, window: int, key: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row for each length
    plan = packing_plan(histogram, window).sort_values(["length", "lo"])
    lookup = {int(n): tuple(g[c].to_numpy(np.int64) for c in ("lo", "each", "first", "offset")) for n, g in plan.groupby("length")}
    sent = cut.sparkSession.sparkContext.broadcast(lookup)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = np.zeros((2, len(length)), np.int64)
        lengths, numbers = length.to_numpy(), number.to_numpy()
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            lo, each, first, offset = sent.value[int(n)]
            row = np.searchsorted(lo, numbers[at], "right") - 1
            k = numbers[at] - lo[row]
            out[0, at] = first[row] + k // each[row]
            out[1, at] = offset[row] + k % each[row] * n
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    placed = numbered(cut, ["length"], [key, "start", "ids_crc32", "doc_tokens"], "_number").withColumn("_place", place("length", "_number"))
    return placed.select(*cut.columns, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document."""
    return pack(persist_table(pieces(docs, tokenizer, end_id, window), "pieces"), window)

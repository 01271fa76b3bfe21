"""Blocks of whole texts, and the question which of their keys other blocks have too.

Operators on word windows read every text several times but shuffle little: the
texts are written once as compressed blocks of some MB, each pass works its
keys out anew, and only sorted arrays of distinct keys travel, dealt by their
highest bits into parts of about ``PART_KEYS`` keys. A key that a third of all
documents hold is one entry for each block, so no part grows with it. What
comes back is one bit for each key sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_groups, few_at_a_time, give_back, let_go, persist_table

BLOCK_BYTES = 3 << 20
PART_KEYS = 1_000_000
NO_ID = np.iinfo(np.int64).max
SENT = "block long, part long, keys binary, checks binary, ids binary"
BLOCK = "block long, ids binary, sizes binary, bytes long, data binary"
TOLD = "block long, level int, part long, bits binary"


def write_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All rows, whole texts, as a written table: block, ids (int64, null as ``NO_ID``), sizes, bytes, data."""

    names = [c.split()[0] for c in BLOCK.split(", ")]

    def collect(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def block():
            return pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, pack_texts(number, ids, texts))})

        for batch in few_at_a_time(batches):
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(NO_ID if i is None else i)
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield block()
                    number, ids, texts, held = number + 1, [], [], 0
        if texts:
            yield block()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return persist_table(rows.mapInArrow(collect, BLOCK), "blocks", packed=True)


def texts_of(ids: bytes, sizes: bytes, n: int, data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of a block."""
    raw = pa.decompress(data, n, "zstd", asbytes=True) if n else b""
    ends = np.cumsum(np.frombuffer(sizes, "<i8"))
    return np.frombuffer(ids, "<i8"), [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def parts_for(blocks: DataFrame, keys_per_byte: float) -> int:
    """Number of parts for about that many keys for each byte of text."""
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return bounded_groups(int(total * keys_per_byte), PART_KEYS)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Parts by the highest bits; ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def sent(block: int, keys: np.ndarray, parts: int, checks: np.ndarray | None = None, ids: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of ``SENT`` for a block's sorted distinct keys."""
    at = np.flatnonzero(np.diff(part_of(keys, parts), prepend=np.uint64(2**64 - 1))) if len(keys) else []
    for a, b in zip(at, [*at[1:], len(keys)]):
        yield (block, int(part_of(keys[a:a + 1], parts)[0]), keys[a:b].tobytes(), b"" if checks is None else checks[a:b].tobytes(),
               b"" if ids is None else ids[a:b].tobytes())


def unpack(rows: dict[int, bytes], keys: np.ndarray, parts: int) -> np.ndarray:
    """The bits that came back (by part) for the keys that were sent."""
    out = np.zeros(len(keys), bool)
    of = part_of(keys, parts)
    for part, bits in rows.items():
        a, b = np.searchsorted(of, [np.uint64(part), np.uint64(part + 1)])
        out[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
    return out


def told(keys: DataFrame, level: int) -> DataFrame:
    """For every key sent, whether other blocks have it too.

    With ``ids``, whether another block has it (with the same check) under a
    smaller id.
    """

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        let_go()
        lists = [np.frombuffer(x, "<u8") for x in frame["keys"]]
        sizes = [len(x) for x in lists]
        all_keys = np.concatenate(lists)
        ids = np.frombuffer(b"".join(frame["ids"]), "<i8")
        if len(ids):
            checks = np.frombuffer(b"".join(frame["checks"]), "<u4")
            order = np.lexsort((ids, checks, all_keys))
            k, c, i = all_keys[order], checks[order], ids[order]
            first = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            least = i[np.flatnonzero(first)][np.cumsum(first) - 1]
            yes = i > least
        else:
            order = np.argsort(all_keys, kind="stable")
            k = all_keys[order]
            same = k[1:] == k[:-1]
            yes = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out = np.empty(len(yes), bool)
        out[order] = yes
        ends = np.cumsum(sizes)
        bits = [np.packbits(out[e - n:e]).tobytes() for e, n in zip(ends, sizes)]
        del lists, all_keys, order, k, yes, out
        give_back()
        return pd.DataFrame({"block": frame["block"], "level": np.int32(level), "part": frame["part"], "bits": bits})

    return persist_table(keys.groupBy("part").applyInPandas(answer, TOLD), "told", packed=True)


def counted(keys: DataFrame, level: int) -> DataFrame:
    """For every key sent, the sum of its ``checks`` over all blocks (at most 65535), as compressed 16-bit numbers."""

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        let_go()
        lists = [np.frombuffer(x, "<u8") for x in frame["keys"]]
        all_keys, of = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(of, np.frombuffer(b"".join(frame["checks"]), "<u4"), len(all_keys))
        out = np.minimum(sums[of], 65535).astype("<u2")
        ends = np.cumsum([len(x) for x in lists])
        bits = [pa.compress(out[e - len(x):e].tobytes(), "zstd", asbytes=True) for e, x in zip(ends, lists)]
        del lists, all_keys, of, sums, out
        give_back()
        return pd.DataFrame({"block": frame["block"], "level": np.int32(level), "part": frame["part"], "bits": bits})

    return persist_table(keys.groupBy("part").applyInPandas(answer, TOLD), "counted", packed=True)


def unpack_counts(rows: dict[int, bytes], keys: np.ndarray, parts: int) -> np.ndarray:
    """The sums that came back (by part) for the keys that were sent."""
    out = np.zeros(len(keys), np.int64)
    of = part_of(keys, parts)
    for part, packed in rows.items():
        a, b = np.searchsorted(of, [np.uint64(part), np.uint64(part + 1)])
        out[a:b] = np.frombuffer(pa.decompress(packed, 2 * int(b - a), "zstd", asbytes=True), "<u2")
    return out


def pack_texts(block: int, ids: list[int], texts: list[bytes]) -> tuple:
    """A row of ``BLOCK``."""
    data = b"".join(texts)
    return (block, np.array(ids, "<i8").tobytes(), np.fromiter(map(len, texts), "<i8", len(texts)).tobytes(), len(data),
            pa.compress(data, "zstd", asbytes=True))


def with_answers(blocks: DataFrame, answers: DataFrame | None, work: Callable, schema: str) -> DataFrame:
    """Calls ``work(block, ids, texts, {level: {part: bits}})`` for every block; it yields rows of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame, said: pd.DataFrame | None) -> pd.DataFrame:
        let_go()
        rows: list[tuple] = []
        by: dict[int, dict[int, bytes]] = {}
        if said is not None:
            for level, part, bits in zip(said["level"], said["part"], said["bits"]):
                by.setdefault(int(level), {})[int(part)] = bits
        for r in frame.itertuples():
            rows += work(int(r.block), *texts_of(r.ids, r.sizes, r.bytes, r.data), by)
        give_back()
        return pd.DataFrame(rows, columns=names, dtype=object)  # a null id must not turn ids into floats

    if answers is None:
        def each(frames):
            for frame in frames:
                for i in range(len(frame)):
                    yield run(frame.iloc[i:i + 1], None)

        return blocks.mapInPandas(each, schema)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)

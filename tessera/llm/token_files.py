"""Token files: Arrow IPC files of fixed-size-list batches, and random access to them.

A file holds the ids of its documents end to end, cut into sequences of
``length`` ids. Batches have two columns: ``tokens``, a fixed-size list of
unsigned 16- or 32-bit ids, and ``mask``, a fixed-size list of bits that are
false on the padding of the file's last sequence. All batches but the last have
the same number of sequences, so sequence ``i`` is found by one division in the
file's footer and read from the memory map without a copy. A second file has a
row for each document: its id, where it starts and how many ids it has.

Executors write to the shared folder under names of their own; a manifest, the
rows of the tasks that succeeded, says which files count, so files left by lost
or repeated tasks are never read.

Defined cases: a null text is empty, an empty text is its end id alone; null
keys come first; equal keys are ordered by a hash of their text, and equal rows
are kept; an empty input writes no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import few_at_a_time, persist_table, scratch_path
from tessera.llm.tokens import encoder

BATCH_SEQUENCES = 128
INDEX = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class SequenceWriter:
    """Appends ids; every full batch goes to the file at once, so memory is one batch."""

    def __init__(self, path: str, length: int, dtype: str, batch: int = BATCH_SEQUENCES):
        fs, at = _filesystem(path)
        self.length, self.dtype, self.room = length, np.dtype(dtype), batch * length
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))],
                                {"batch_sequences": str(batch)})
        self.sink = fs.open_output_stream(at)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.written = 0

    def append(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.room:
            flat = np.concatenate(self.waiting)
            full = len(flat) // self.room * self.room
            for at in range(0, full, self.room):
                self._write(flat[at:at + self.room], self.room)
            self.waiting, self.held = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, n: int) -> None:
        size = -(-n // self.length) * self.length
        tokens = np.zeros(size, self.dtype)
        tokens[:n] = ids
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (tokens, np.arange(size) < n)]
        self.file.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written += n

    def close(self) -> int:
        if self.held:
            self._write(np.concatenate(self.waiting), self.held)
        self.file.close()
        self.sink.close()
        return self.written


class SequenceFile:
    """Random access to the sequences of a file; local files are memory-mapped and not copied."""

    def __init__(self, path: str):
        fs, at = _filesystem(path)
        source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("tokens").type.list_size
        self.batch = int(self.file.schema.metadata[b"batch_sequences"])
        self._at, self._now = -1, None

    def _columns(self, k: int) -> tuple[pa.Array, pa.Array]:
        if k != self._at:
            self._at, self._now = k, self.file.get_batch(k)
        return self._now.column(0), self._now.column(1)

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence ``i``."""
        tokens, mask = self._columns(i // self.batch)
        j = i % self.batch
        return (tokens.flatten().to_numpy(zero_copy_only=True)[j * self.length:(j + 1) * self.length],
                mask.slice(j, 1).flatten())

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of ``n`` ids from id ``start`` of the file on, a batch at a time."""
        size = self.batch * self.length
        while n > 0:
            flat = self._columns(start // size)[0].flatten().to_numpy(zero_copy_only=True)
            part = flat[start % size:start % size + n]
            if not len(part):
                raise EOFError(start)
            yield part
            start, n = start + len(part), n - len(part)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, key: str = "doc_id",
                length: int = 2048, dtype: str = "uint16") -> DataFrame:
    """Write the documents in ascending key order; returns the manifest.

    Manifest: part (the order of files), file, documents, tokens.
    """
    ordered = docs.select(F.col(key).cast("long").alias("key"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(
        "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    highest = np.iinfo(dtype).max

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype)
        sequences = index = sink = None
        documents = tokens = 0
        for batch in few_at_a_time(batches):
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            if sequences is None:
                fs, at = _filesystem(name)
                fs.create_dir(at.rpartition("/")[0])
                sequences = SequenceWriter(f"{name}.arrow", length, dtype)
                sink = fs.open_output_stream(f"{at}.docs.arrow")
                index = pa.ipc.new_file(sink, INDEX)
            sizes = np.empty(len(texts), np.int64)
            for i, ids in enumerate(encode(texts)):
                ids = np.frombuffer(ids, "<u4")
                if len(ids) and ids.max() > highest:
                    raise OverflowError(f"an id over {highest}: choose a wider dtype")
                sequences.append(ids.astype(dtype))
                sequences.append(end)
                sizes[i] = len(ids) + 1
            starts = tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            index.write_batch(pa.record_batch([keys.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=INDEX))
            documents += len(texts)
            tokens += int(sizes.sum())
        if sequences is not None:
            sequences.close()
            index.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name],
                                              "documents": [documents], "tokens": [tokens]})

    return persist_table(ordered.mapInArrow(write, "part int, file string, documents long, tokens long"), "manifest")


def read_documents(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document as it lies in the files: key, start over all files, n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = files.repartition(max(1, manifest.count()))

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sequences = SequenceFile(f"{name}.arrow")
                fs, at = _filesystem(f"{name}.docs.arrow")
                with fs.open_input_file(at) as source:
                    index = pa.ipc.open_file(source)
                    for k in range(index.num_record_batches):
                        rows = index.get_batch(k)
                        starts, sizes = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                        sums = np.zeros(len(starts), np.int64)
                        for i, (start, n) in enumerate(zip(starts.tolist(), sizes.tolist())):
                            crc = 0
                            for part in sequences.span(start, n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            sums[i] = crc
                        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(starts + base), rows.column(2), pa.array(sums)],
                                                         ["key", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("key", key)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "token-files")
    return read_documents(write_files(docs, tokenizer, end_id, folder))

"""A keyed table kept up to date by micro-batches, in snapshots.

Rows lie in hash buckets of the key, each bucket's rows in one folder of Parquet
files. A manifest names the live folder of every bucket; publishing a manifest is
one rename, so readers see a batch whole or not at all and no folder is ever
written twice. A batch rewrites only the buckets that it touches:

1. its newest row per key is staged by bucket (the batch is evaluated this once);
2. touched buckets that have rows already are read from their live folders,
   merged with the staged rows and written to a new folder, large buckets split
   over several files and small ones in one (``rebalance``); the others take the
   staged folder as it is;
3. the manifest of the batch is published: its own folders and, for all other
   buckets, those of the manifest before.

A batch whose manifest is there already changes nothing, so replays after a
failure are harmless; an attempt that fails before it publishes leaves folders that
no manifest names. ``expire`` removes old manifests and every folder that none of those
left names.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.cleaning import dedupe_latest


class SnapshotTable:
    """The newest row per key under ``order`` (make it total), in ``buckets`` buckets below ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.schema = spark, root, schema
        self.keys, self.order, self.buckets = list(keys), list(order), buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifests

    def _file(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def _list(self, *parts: str) -> list[str]:
        at = self._file(*parts)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Published batches, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in self._list("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """Bucket -> folder of a version, the newest by default; empty before the first."""
        have = self.versions()
        if version is None and not have:
            return {}
        stream = self._fs.open(self._file("manifests", f"{have[-1] if version is None else version:020d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(b): folder for b, folder in json.loads(text).items()}

    def _publish(self, version: int, live: dict[int, str]) -> None:
        draft = self._file("manifests", f".{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(json.dumps({str(b): live[b] for b in sorted(live)}).encode()))
        finally:
            out.close()
        if not self._fs.rename(draft, self._file("manifests", f"{version:020d}.json")):
            raise OSError(f"version {version} of {self.root} could not be published")

    # ------------------------------------------------------------ rows

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the newest by default; an empty table before the first."""
        return self._folders(sorted(self.manifest(version).values()))

    def _write(self, df: DataFrame, name: str) -> dict[int, str]:
        """Rows with their ``_bucket`` to a folder of their own; bucket -> folder."""
        folder = f"data/{name}-{uuid.uuid4().hex[:12]}"
        df.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
        return {int(n.removeprefix("_bucket=")): f"{folder}/{n}" for n in self._list(folder) if n.startswith("_bucket=")}

    def merge(self, batch: DataFrame, version: int) -> None:
        """Takes the rows of a batch in, once."""
        if version in self.versions():
            return
        columns = self.schema.fieldNames()
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("_bucket")
        new = self._write(dedupe_latest(batch.select(*columns), self.keys, self.order).select(*columns, bucket), f"{version}-staged")
        if not new:
            return
        live = self.manifest()
        old = {b: live[b] for b in new if b in live}
        if old:
            rows = self._folders(sorted(old.values())).unionByName(self._folders([new[b] for b in sorted(old)]))
            new |= self._write(dedupe_latest(rows, self.keys, self.order).select(*columns, bucket), f"{version}-merged")
        self._publish(version, live | new)

    def expire(self, keep: int = 2) -> int:
        """Removes all but the newest ``keep`` versions and the folders that no version left names; how many folders went.

        Not to be run while a batch is being merged: folders of an open attempt are not named yet.
        """
        have = self.versions()
        kept = have[-max(1, keep):]
        named = {folder for v in kept for folder in self.manifest(v).values()}
        for v in have[:-max(1, keep)]:
            self._fs.delete(self._file("manifests", f"{v:020d}.json"), False)
        gone = 0
        for name in self._list("data"):
            inside = [n for n in self._list("data", name) if n.startswith("_bucket=")]
            for n in inside:
                if f"data/{name}/{n}" not in named:
                    self._fs.delete(self._file("data", name, n), True)
                    gone += 1
            if not any(f"data/{name}/{n}" in named for n in inside):
                self._fs.delete(self._file("data", name), True)
        return gone


def upsert_sink(stream: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int = 64,
                root: str | None = None, keep: int = 2) -> DataFrame:
    """Runs a stream over everything available into a ``SnapshotTable`` and returns its newest snapshot.

    With the ``root`` of an earlier run the stream goes on from that run's checkpoint. After each batch
    versions before the newest ``keep`` are removed.
    """
    from tessera.session import scratch_path

    spark = stream.sparkSession
    root = root or scratch_path(spark, name)
    table = SnapshotTable(spark, os.path.join(root, "table"), stream.schema, keys, order, buckets)

    def take(batch: DataFrame, batch_id: int):
        table.merge(batch, batch_id)
        table.expire(keep)

    q = (stream.writeStream.foreachBatch(take).outputMode("append")
         .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return table.read()

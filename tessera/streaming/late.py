"""Late rows as a side output.

Spark drops a row that comes after the watermark has passed its window, and its
metric counts such rows only after a partial aggregate. Here a stateful
splitter has the watermark in hand instead: a row whose window is closed goes out
whole, marked late; any other counts in its window, whose state goes when the
watermark closes it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tessera.operators.joins import _grain_micros

#: What the splitter needs of the session while its stream runs.
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _as_text(c: Column, kind: T.DataType) -> Column:
    """A value as text that ``_from_text`` reads back unchanged, in any session zone."""
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.BinaryType):
        return F.base64(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"late rows carry atomic columns, not {kind.simpleString()}")
    return c.cast("string")


def _from_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(c.cast("long"))
    return F.unbase64(c) if isinstance(kind, T.BinaryType) else c.cast(kind)


class _Splitter(StatefulProcessor):
    """One window of one key (and salt): how many rows it has taken."""

    def __init__(self, keys: int, columns: Sequence[str]):
        self.keys, self.columns = keys, list(columns)

    def init(self, handle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        names = ["_end", *[f"_k{i}" for i in range(self.keys)]]
        said = dict(zip(names, key))
        if key[0] <= timerValues.getCurrentWatermarkInMs():
            for frame in rows:
                row = frame.iloc[:, self.keys + 2:].set_axis(self.columns, axis=1)  # by place: frames name columns by number
                yield row.assign(**said, _salt=key[-1], _taken=0, _late=True)[[*names, "_salt", "_taken", "_late", *self.columns]]
            return
        before = self.taken.get()
        n = (before[0] if before else 0) + sum(len(frame) for frame in rows)
        self.taken.update((n,))
        self.handle.registerTimer(key[0])
        yield pd.DataFrame([[*key, n, False, *[None] * len(self.columns)]], columns=[*names, "_salt", "_taken", "_late", *self.columns], dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.taken.clear()
        return iter(())

    def close(self) -> None:
        pass


def split_late(stream: DataFrame, ts: str, size: str, by: Sequence[str], delay: str, salts: int = 8) -> DataFrame:
    """Splits a stream at its closed windows; run it in update mode with ``STATE_CONF``.

    A row is late if its tumbling window of ``size`` (counted from 1970-01-01 00:00 UTC)
    ends at or before the watermark in force when its micro-batch starts: the
    latest event time of earlier batches less ``delay``. Returns changelog rows for
    ``late_rows`` and ``window_counts``: each late row whole, and for each open
    window that a batch adds to the count so far. A window is kept as ``salts``
    counts, dealt by a hash of the row, so the rows of one key and window are
    worked on by that many tasks. Rows without a time have no window and are left
    out; null keys are keys. Columns must be atomic.
    """
    width = _grain_micros(size)
    columns = {f"_c{i}": f for i, f in enumerate(stream.schema.fields)}
    micros = F.unix_micros(F.col(ts))
    end = (F.floor(micros / width).cast("long") + 1) * width
    marked = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    # without the watermark's own column the operator gets late rows too
    rows = marked.select(F.floor(end / 1000).cast("long").alias("_end"), *[_as_text(F.col(c), stream.schema[c].dataType).alias(f"_k{i}") for i, c in enumerate(by)],
                         F.pmod(F.xxhash64(*stream.columns), F.lit(salts)).cast("int").alias("_salt"),
                         *[_as_text(F.col(f"`{f.name}`"), f.dataType).alias(n) for n, f in columns.items()])
    keys = [f"_k{i}" for i in range(len(by))]
    text = T.StringType()
    schema = T.StructType([T.StructField("_end", T.LongType()), *[T.StructField(k, text) for k in keys], T.StructField("_salt", T.IntegerType()),
                           T.StructField("_taken", T.LongType()), T.StructField("_late", T.BooleanType()), *[T.StructField(n, text) for n in columns]])
    out = rows.groupBy("_end", *keys, "_salt").transformWithStateInPandas(_Splitter(len(by), list(columns)), schema, "Update", "EventTime")
    row = F.when(F.col("_late"), F.struct(*[_from_text(F.col(n), f.dataType).alias(f.name) for n, f in columns.items()]))
    starts = F.timestamp_micros(F.col("_end") * 1000 - width)
    return out.select(starts.alias("window_start"), F.timestamp_micros(F.col("_end") * 1000).alias("window_end"), *[
        _from_text(F.col(f"_k{i}"), stream.schema[c].dataType).alias(c) for i, c in enumerate(by)], "_salt", "_taken", "_late", row.alias("_row"))


def late_rows(changelog: DataFrame) -> DataFrame:
    """The late rows themselves, as they came."""
    return changelog.where("_late").select("_row.*")


def window_counts(changelog: DataFrame, by: Sequence[str]) -> DataFrame:
    """For every window and key: n, the rows that counted, and n_late, those that came too late."""
    keys = ["window_start", "window_end", *by]
    parts = changelog.groupBy(*keys, "_salt").agg(F.max("_taken").alias("n"), F.count(F.when(F.col("_late"), 1)).alias("n_late"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))

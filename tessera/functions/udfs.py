"""Python where Spark has no built-in.

``fold_groups`` is for groups of any size: a function turns a bounded chunk of rows
into a state, another merges states, so no frame grows with a group. Group-aware
functions (``many=True``) fold all groups of an Arrow batch at once.

``per_group`` hands groups to a pandas function through ``applyInPandas``
(Arrow batches). A whole group is one pandas frame in one task, so the
grouping keys must bound the group size: group by a natural key *and* a time
bucket (as the per-(user, day) job does), never by a key alone when one key
can hold a large share of the rows.

With ``buckets=n`` Spark groups by a hash bucket of the keys instead, and the
function receives several complete groups per call (it must be group-aware,
e.g. use ``groupby``): one Python call per bucket instead of one per group,
which removes the per-group call overhead when groups are many and small.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.session import persist_table


def per_group(df: DataFrame, by: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
              schema: str, buckets: int | None = None) -> DataFrame:
    """Apply a pandas function to every group (``groupBy().applyInPandas``),
    or to hash buckets of whole groups when ``buckets`` is given."""
    if not buckets:
        return df.groupBy(*by).applyInPandas(fn, schema=schema)
    keyed = df.withColumn("_bucket", F.pmod(F.xxhash64(*by), F.lit(buckets)))
    return keyed.groupBy("_bucket").applyInPandas(
        lambda pdf: fn(pdf.drop(columns="_bucket")), schema=schema)


def seconds_since_previous(pdf: pd.DataFrame, by: Sequence[str] = ("user_id", "day")) -> pd.DataFrame:
    """Seconds since the previous row of the same group in (ts, event_id)
    order; group-aware, so it serves one group or a bucket of many."""
    pdf = pdf.sort_values([*by, "ts", "event_id"])
    gap = pdf.groupby(list(by), sort=False)["ts"].diff().dt.total_seconds()
    return pd.DataFrame({"event_id": pdf["event_id"].to_numpy(), "secs_since_prev": gap.to_numpy()})


def fold_groups(df: DataFrame, by: Sequence[str], chunk: Callable, merge: Callable, state: str,
                chunk_rows: int = 10_000, fan_in: int = 64, many: bool = False) -> DataFrame:
    """Folds every group with Python, in frames of bounded size; returns by and the ``state`` columns, a row for each group.

    ``chunk`` gets up to ``chunk_rows`` rows of one group and returns its states (dicts
    of the columns of ``state``, usually one). ``merge`` gets up to about ``fan_in``
    states of one group and returns one. It must not matter how rows and states are dealt:
    merging is associative and commutative.

    With ``many`` a call folds many groups, so that small groups cost no call each: both
    get an Arrow batch in which the rows of a group lie together and the numbers of the
    rows at which groups begin, and return the ``state`` columns as Arrow arrays, a row for each group.

    Chunks are taken where the rows lie, before any shuffle. States then meet in turns:
    a group with many of them is dealt over as many tasks as ``fan_in`` asks for, so a
    group of any share of the rows is never in one frame, and each turn divides its states
    by about ``fan_in`` (hash shares vary, so a frame may hold a few times as many). States
    come sorted by group and are merged batch by batch, so no task holds its states whole.
    Null keys are groups; an empty input gives no rows.
    """
    by = list(by)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    names = [f.split()[0].strip("`") for f in _columns(state)]
    schema = f"{keys}, {state}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    if many:
        of_rows, of_states = chunk, merge
    else:
        types = [arrow.field(n).type for n in names]
        of_rows, of_states = _one_by_one(chunk, types, names), _one_by_one(lambda f: [merge(f[names])], types, names)

    def folded(rows, on: list[str], fold: Callable):
        import pyarrow as pa

        code = _group_codes(rows, on)
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        rows = rows.take(pa.array(order))
        states = fold(rows, starts)
        if not many:
            of, states = states
            starts = starts[of]
        heads = rows.select(by).take(pa.array(starts))
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip([*heads.columns, *states], arrow)], schema=arrow)

    def first(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, chunk_rows):
                yield folded(batch.slice(lo, chunk_rows), by, of_rows)

    def merged(states: DataFrame, on: list[str]) -> DataFrame:
        def turn(batches):
            import pyarrow as pa

            held = None  # the group that may go on in the next batch
            for batch in batches:
                rows = batch if held is None else pa.concat_batches([held, batch])
                if not rows.num_rows:
                    continue
                code = _group_codes(rows, on)
                last = code == code[-1]
                if not last.all():
                    yield folded(rows.take(pa.array(np.flatnonzero(~last))), on, of_states)
                held = rows.take(pa.array(np.flatnonzero(last)))
            if held is not None:
                yield folded(held, on, of_states)

        return states.repartition(*on).sortWithinPartitions(*on).mapInArrow(turn, schema)

    for c in by:  # values that are one group are one value
        if df.schema[c].dataType.typeName() in ("float", "double"):
            kind = df.schema[c].dataType
            df = df.withColumn(c, F.nanvl(F.col(f"`{c}`") + F.lit(0.0).cast(kind), F.lit(None).cast(kind)))
    states = persist_table(df.mapInArrow(first, schema), "states")
    while True:
        sizes = states.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        most = sizes.agg(F.max("_n")).first()[0] or 0
        if most <= fan_in:
            return merged(states, by)
        dealt = states.join(sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_n"), _null_safe(states, by)).withColumn(
            "_share", F.floor(F.rand(7) * F.ceil(F.col("_n") / fan_in)).cast("int")).select(*by, "_share", *names)
        states = persist_table(merged(persist_table(dealt, "dealt"), [*by, "_share"]), "states")


def _group_codes(rows, by: Sequence[str]) -> np.ndarray:
    """A number for each row of an Arrow batch, one for each group; nulls are a value."""
    code = np.zeros(rows.num_rows, np.int64)
    for c in by:
        found = rows.column(c).dictionary_encode("encode")
        code = np.unique(code * (len(found.dictionary) + 1) + found.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code


def _one_by_one(fold: Callable[[pd.DataFrame], list[dict]], types: list, names: list[str]) -> Callable:
    """Folds each group of a batch alone; returns the group of each state beside the columns."""

    def every(rows, starts: np.ndarray):
        import pyarrow as pa

        frame = rows.to_pandas(integer_object_nulls=True)  # whole numbers stay whole beside nulls
        got = [(g, s) for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(frame)])) for s in fold(frame.iloc[a:b].reset_index(drop=True))]
        return np.array([g for g, _ in got], np.int64), [pa.array([s[n] for _, s in got], t, from_pandas=True) for n, t in zip(names, types)]

    return every


def _columns(state: str) -> list[str]:
    """The columns of a schema string, split at commas outside brackets."""
    out, depth = [""], 0
    for c in state:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


def _null_safe(df: DataFrame, by: Sequence[str]):
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & df[c].eqNullSafe(F.col(f"_k{i}"))
    return out


def group_spans(group: np.ndarray, first: np.ndarray, last: np.ndarray, groups: int):
    """For every group 0 .. groups - 1 its sorted spans of days, those that touch or overlap as one, as an Arrow array of lists of [first, last]."""
    import pyarrow as pa

    shift, zero = np.int64(33), np.int64(1) << 31  # days are 32-bit numbers; groups lie further apart than any days
    a, b = ((group.astype(np.int64) << shift) + x.astype(np.int64) + zero for x in (first, last))
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), a[1:] > reach[:-1] + 1]))
    ends = np.append(at[1:], len(a))[:len(at)] - 1
    days = np.stack([a[at], reach[ends]], 1) - ((a[at] >> shift) << shift)[:, None] - zero
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(at) + 1, 2, np.int32)), pa.array(days.astype(np.int32).ravel()))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(a[at] >> shift, minlength=groups))])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs)


def _groups_of(starts: np.ndarray, rows: int) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows)))


def _spans_of_days(rows, starts: np.ndarray) -> list:
    days = rows.column("_d").to_numpy(zero_copy_only=False)
    return [group_spans(_groups_of(starts, len(days)), days, days, len(starts))]


def _spans_of_spans(rows, starts: np.ndarray) -> list:
    lists = rows.column("spans")
    days = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
    group = np.repeat(_groups_of(starts, len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return [group_spans(group, days[:, 0], days[:, 1], len(starts))]


def active_spans(df: DataFrame, by: Sequence[str], day: str, chunk_rows: int = 10_000, fan_in: int = 64) -> DataFrame:
    """by, spans: the maximal spans of consecutive days (numbers since 1970-01-01) on which a group has rows.

    A state is a list of spans, at most one for every second day, whatever the rows."""
    rows = df.select(*by, F.unix_date(F.col(day)).alias("_d")).where(F.col("_d").isNotNull())
    return fold_groups(rows, by, _spans_of_days, _spans_of_spans, "spans array<array<int>>", chunk_rows, fan_in, many=True)

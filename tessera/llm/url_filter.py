"""Exact URL lists as a cascade of Bloom filters.

Level 1 holds the listed keys, level 2 those other keys of the corpus that pass
level 1, level 3 the listed ones that pass level 2, and so on until a level
lets no wrong key through. Over the universe it was built on, a key is listed
exactly if the first level that refuses it has an even number (or it passes an
odd number of levels in all), so pages are judged without a join.

The universe (all distinct keys of the corpus) is split by hash into shards of
about ``SHARD_KEYS`` keys and every shard gets its own cascade in one bounded
task. The finished bits are broadcast in blocks of at most ``block_bytes``;
pages pass one block after the other, in a pass of its own that is written if there
are several, so a worker holds one block at a time and any list size works the same way.

Defined cases: a null key is never listed; a key outside the universe gets an
answer that may be wrong (build over all keys); repeated listed or universe
rows count once; an empty list blocks nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_groups, persist_table

SHARD_KEYS = 200_000
FIRST_RATE = 0.02  # false positives of a level
_ODD, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _places(keys: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit numbers of 64-bit keys in one level, a row for each key."""
    x = keys + np.uint64((_ODD * (2 * level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX)
    x ^= x >> np.uint64(27)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return ((x[:, None] + np.arange(hashes, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


def _filter(keys: np.ndarray, level: int, rate: float) -> tuple[np.ndarray, int, int]:
    bits = max(64, int(math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2)))
    hashes = max(1, round(-math.log2(rate)))
    has = np.zeros(bits, bool)
    has[_places(keys, level, bits, hashes).ravel()] = True
    return has, bits, hashes


def build_levels(listed: np.ndarray, others: np.ndarray, rate: float = FIRST_RATE) -> list[tuple[int, int, bytes]]:
    """Levels (bits, hashes, packed bits) that tell ``listed`` from ``others``, both of distinct 64-bit keys."""
    levels, inside, outside = [], listed, others
    while len(inside):
        has, bits, hashes = _filter(inside, len(levels), rate)
        levels.append((bits, hashes, np.packbits(has).tobytes()))
        outside = outside[has[_places(outside, len(levels) - 1, bits, hashes)].all(1)] if len(outside) else outside
        inside, outside = outside, inside
    return levels


def passes(levels: list[tuple[int, int, np.ndarray]], keys: np.ndarray) -> np.ndarray:
    """Whether each key is listed, by its way down the cascade."""
    out = np.zeros(len(keys), bool)
    left = np.arange(len(keys))
    for k, (bits, hashes, packed) in enumerate(levels):
        if not len(left):
            break
        at = _places(keys[left], k, bits, hashes)
        there = ((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1)
        out[left[~there]] = k % 2 == 1
        left = left[there]
        out[left] = k % 2 == 0
    return out


def _key64(key: Column) -> Column:
    return F.xxhash64(key)


def build(universe: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The cascades as a written table: shard, shards, level, bits, hashes, packed.

    ``universe`` and ``listed`` each have a column ``key``; listed keys need not
    be in the universe. Two keys with one 64-bit hash would be one key.
    """
    listed = listed.select(F.col(key).alias("key")).withColumn("wanted", F.lit(1))
    keys = universe.select(F.col(key).alias("key")).withColumn("wanted", F.lit(0)).unionByName(listed)
    keys = persist_table(keys.where(F.col("key").isNotNull()).groupBy(_key64(F.col("key")).alias("h")).agg(F.max("wanted").alias("wanted")), "keys")
    shards = bounded_groups(keys.count(), SHARD_KEYS)

    def cascade(frame: pd.DataFrame) -> pd.DataFrame:
        h = frame["h"].to_numpy().view(np.uint64)
        wanted = frame["wanted"].to_numpy() == 1
        rows = [(int(frame["shard"].iloc[0]), shards, k, *level) for k, level in enumerate(build_levels(h[wanted], h[~wanted]))]
        return pd.DataFrame(rows, columns=["shard", "shards", "level", "bits", "hashes", "packed"])

    sharded = keys.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int"))
    return persist_table(sharded.groupBy("shard").applyInPandas(
        cascade, "shard int, shards int, level int, bits long, hashes int, packed binary"), "cascade")


def _listed_in(sent, shards: int):
    """A column function: listed by a broadcast block of cascades, or so already."""

    @F.pandas_udf("boolean")
    def listed(h: pd.Series, was: pd.Series) -> pd.Series:
        keys = h.to_numpy().astype(np.int64)
        of, out = np.mod(keys, shards), was.to_numpy(bool, copy=True)
        by: dict[int, list] = {}
        for shard, bits, hashes, packed in sent.value:
            by.setdefault(shard, []).append((bits, hashes, np.frombuffer(packed, np.uint8)))
        for shard in np.intersect1d(of, list(by)):
            at = of == shard
            out[at] = passes(by[shard], keys[at].view(np.uint64))
        return pd.Series(out)

    return listed


def listed_flag(df: DataFrame, key: Column, cascade: DataFrame, name: str = "listed", block_bytes: int = 64 << 20) -> DataFrame:
    """Adds a boolean column: whether the row's key is listed."""
    sizes = cascade.groupBy("shard", "shards").agg(F.sum(F.octet_length("packed")).alias("n")).orderBy("shard").toLocalIterator()
    blocks: list[list[int]] = []
    room = shards = 0
    for r in sizes:
        shards = r["shards"]
        if not blocks or r["n"] > room:
            blocks.append([])
            room = block_bytes
        blocks[-1].append(r["shard"])
        room -= r["n"]
    out = df.withColumn("_h", _key64(key)).withColumn(name, F.lit(False))
    for block in blocks:  # one in practice: 64 MB hold some 60 million listed keys
        rows = cascade.where(F.col("shard").between(block[0], block[-1])).orderBy("shard", "level").collect()
        sent = df.sparkSession.sparkContext.broadcast([(r["shard"], r["bits"], r["hashes"], bytes(r["packed"])) for r in rows])

        out = out.withColumn(name, _listed_in(sent, shards)("_h", name))
        if len(blocks) > 1:
            out = persist_table(out, "listed")
            sent.unpersist()
    return out.withColumn(name, F.col(name) & key.isNotNull()).drop("_h")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict (null if none fits).

    A rule is ``host`` and ``path`` in one string; it fits its host and all
    subdomains if the path starts with the rule's. Among rules of one length the
    one with the longer host wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in sorted(rules, key=lambda r: (len(r), r.index("/"))):  # the last that fits stands
        h, p = name[:name.index("/")], name[name.index("/"):]
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[name])).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: dict[str, str], listed: DataFrame, by: str = "host") -> DataFrame:
    """page_id, host, path, rule, verdict: the longest rule's verdict, else block for what is listed.

    ``by`` is ``host`` or ``url`` (host and path in one string); ``listed`` has a column of that name, and
    membership is by exact key, through the cascade over all keys of the pages.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    key = {"host": F.col("host"), "url": F.concat("host", "path")}[by]
    cascade = build(parts.select(key.alias(by)).distinct(), listed, by)
    flagged = listed_flag(parts, key, cascade)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
        verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))

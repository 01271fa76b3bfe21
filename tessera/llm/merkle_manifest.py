"""A content-addressed manifest: a tree of digests over the rows of a dataset, and proofs by descent.

Rows are leaves; the leaves of a group, in order of their key, have ranks from 0.
While a group has several nodes, each run of ``FANOUT`` of them (the last may be
shorter, down to one) becomes the digest of its digests; the node that remains
is the group's subroot, and subroots, in order of their group, are joined alike into
the root. What is stored is digest -> children, one record for each digest,
written level by level.

A proof is found from the root down: at each node the request takes the child that
its rank's next digit names and collects the other children; at the leaf
the segments are turned round, so that they lead up. Requests that share the
leading digits go down as one row, so a node is looked up once for all leaves below it,
no key is hotter than its node, and the rows of a level are its nodes. Only the last
step meets the leaves, in runs of ``FANOUT``.

Ranks come from ``with_positions`` (range partitions, no one-task window); a group may
hold any share of the rows. Levels are written to the shared folder, so a lost
executor costs a reread. The driver holds the root and the number of levels alone.

Defined cases: a field that is null is ``-``; null keys stand first in their group; a null
group is a group, before all others; rows equal in key stand in order of their leaf
digests, so equal rows are equal leaves in neighbouring places; one leaf alone is its
subroot, one subroot alone the root; a manifest of no rows has a null root and no proofs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import persist_table
from tessera.operators.ordering import with_positions

FANOUT = 8
SEGMENT = "struct<digit:int,siblings:array<string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row's fields: each ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    def framed(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up."""
    return joined_digest(F.flatten(F.transform(path, lambda s: s["siblings"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    def up(digest: Column, s: Column) -> Column:
        return F.sha2(F.concat(F.array_join(F.slice(s["siblings"], F.lit(1), s["digit"]), ""), digest,
                               F.array_join(F.slice(s["siblings"], s["digit"] + 1, F.lit(FANOUT)), "")), 256)

    return F.aggregate(path, leaf, up)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def _tree(nodes: DataFrame, by: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Records of each level, lowest first, and the top node of every group.

    ``nodes``: by, at (rank), n (nodes of the group), digest. Records: digest,
    children. Tops: by, height, digest.
    """
    records, tops = [], []
    height = 0
    while True:
        tops.append(nodes.where(F.col("n") == 1).select(*by, F.lit(height).alias("height"), "digest"))
        most = nodes.where(F.col("n") > 1)
        if most.isEmpty():
            break
        up = most.groupBy(*by, F.floor(F.col("at") / FANOUT).alias("at"), F.ceil(F.col("n") / FANOUT).alias("n")).agg(
            F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("run"))  # at most FANOUT nodes
        up = up.select(*by, "at", "n", F.col("run.digest").alias("children")).withColumn("digest", joined_digest(F.col("children")))
        nodes = persist_table(up, f"merkle-level{height}")
        records.append(nodes.select("digest", "children"))
        height += 1
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return records, out


def _found(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requests with the children of their digest."""
    store = records.dropDuplicates(["digest"]).select(F.col("digest").alias("stored"), "children")
    return requests.join(store, F.col("digest") == F.col("stored")).drop("stored")


def _others(digit: Column) -> Column:
    """The segment of a path at a node: which child was taken, and the others."""
    return F.struct(digit.cast("int").alias("digit"), F.filter("children", lambda _, i: i != digit).alias("siblings"))


def _down(requests: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Requests (by, at, digest, path from the root) one level down, to every child."""
    down = _found(requests, records).select(*by, "at", "path", "children", F.posexplode("children").alias("digit", "child"))
    return down.select(*by, (F.col("at") * FANOUT + F.col("digit")).alias("at"), F.col("child").alias("digest"),
                       F.concat("path", F.array(_others(F.col("digit")))).alias("path"))


@dataclass
class Manifest:
    """Leaves (group, key, leaf, the whole row, rank), subroots (group, height, digest, rank), records by level, and the root."""

    leaves: DataFrame
    subroots: DataFrame
    records: list[DataFrame]
    upper_records: list[DataFrame]
    group: str
    key: str
    root: str | None

    def store(self) -> DataFrame:
        """All records: digest, children; one for each digest."""
        out = self.subroots.select("digest", F.lit(None).cast("array<string>").alias("children")).where("false")
        for r in [*self.records, *self.upper_records]:
            out = out.unionByName(r)
        return out.dropDuplicates(["digest"])

    def prove(self, requests: DataFrame | None = None) -> DataFrame:
        """The rows asked for (all, or those whose group and key are in ``requests``), with
        subroot, root and path: digit and siblings of each level, from the leaf up.
        Columns of these names in the rows give way.
        """
        leaves, groups = self.leaves, None
        if requests is not None:
            asked = requests.select(F.col(self.group).alias("group"), F.col(self.key).alias("key")).distinct()
            leaves = persist_table(leaves.join(asked, _same(leaves, asked, ["group", "key"]), "left_semi"), "merkle-asked")
            groups = leaves.select("group").distinct()
        nothing = F.array().cast(f"array<{SEGMENT}>")
        top = self.subroots.limit(1).select(F.lit(0).cast("long").alias("at"), F.lit(self.root).alias("digest"), nothing.alias("path"))
        for records in reversed(self.upper_records):
            top = _down(top, records, [])
        starts = self.subroots.join(top.select(F.col("at").alias("rank"), "path"), "rank").select(
            "group", F.lit(0).cast("long").alias("at"), "height", "digest", F.col("digest").alias("subroot"), "path")
        if groups is not None:
            starts = starts.join(groups, _same(starts, groups, ["group"]), "left_semi")
        starts = persist_table(starts, "merkle-starts")

        def begin(height: int) -> DataFrame:
            return starts.where(F.col("height") == height).drop("height")

        now = begin(len(self.records))
        for height in range(len(self.records), 1, -1):
            now = _down(now, self.records[height - 1], ["group", "subroot"])
            if requests is not None:
                want = leaves.select("group", F.floor(F.col("rank") / FANOUT ** (height - 1)).cast("long").alias("at")).distinct()
                now = now.join(want, _same(now, want, ["group", "at"]), "left_semi")
            now = now.unionByName(begin(height - 1))
        met = begin(0).withColumn("children", F.array().cast("array<string>"))
        if self.records:
            met = _found(now, self.records[0]).unionByName(met)
        runs = leaves.groupBy("group", F.floor(F.col("rank") / FANOUT).alias("at")).agg(F.collect_list(F.struct(
            (F.col("rank") % FANOUT).alias("digit"), "row")).alias("run"))  # at most FANOUT leaves
        met = met.join(runs, _same(met, runs, ["group", "at"])).select("subroot", "path", "children", F.explode("run").alias("one"))
        last = F.when(F.size("children") > 0, F.array(_others(F.col("one.digit")))).otherwise(nothing)
        kept = [F.col(f"one.row.`{c}`").alias(c) for c in self.leaves.schema["row"].dataType.names if c not in ("subroot", "root", "path")]
        return met.select(*kept, "subroot", F.lit(self.root).alias("root"), F.reverse(F.concat("path", last)).alias("path"))


def _ranked(rows: DataFrame, order: list[str], by: list[str], name: str) -> DataFrame:
    placed = with_positions(rows, order, by)
    return persist_table(placed.withColumn("rank", F.col("_pos") - 1).withColumnRenamed("_n", "n").drop("_pos"), name)


def build(rows: DataFrame, group: str, key: str, leaf: str) -> Manifest:
    """The manifest of rows that carry their digest in ``leaf``; whole rows stay with their leaf."""
    rows = persist_table(rows.select(F.col(group).alias("group"), F.col(key).alias("key"), F.col(leaf).alias("leaf"), F.struct("*").alias("row")), "merkle-rows")
    leaves = _ranked(rows, ["key", "leaf"], ["group"], "merkle-leaves")
    records, tops = _tree(leaves.select("group", F.col("rank").alias("at"), "n", F.col("leaf").alias("digest")), ["group"])
    subroots = _ranked(persist_table(tops, "merkle-tops"), ["group"], [], "merkle-subroots")
    upper, top = _tree(subroots.select(F.col("rank").alias("at"), "n", "digest"), [])
    root = top.first()  # one row, or none
    return Manifest(leaves, subroots, records, upper, group, key, root["digest"] if root else None)

"""Near duplicates by an n-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles (64-bit hashes). Two
sets of sizes n and m with a Jaccard similarity of ``percent`` or more share, in
any one order of all shingles, at least ``k`` among the first
``n - ceil(percent * n) + k`` and the first ``m - ceil(percent * m) + k``, for
every k up to their overlap. A longer prefix could so ask for more shared
shingles; only step 1 does, by a fixed ``EXTRA``:

1. In the order of the hashes, every set sends its prefix, lengthened by
   ``EXTRA`` of its size; one bit tells for each shingle whether others have it.
   Sets that share fewer than their smallest possible partner asks for are done:
   they link with nothing.
2. The others, equal sets once, count all their shingles among themselves and
   order them from rare to frequent. Each lengthens its prefix by its estimated
   candidate cost (how many others its prefix meets). The demand for as many
   more shared shingles is worked out (``match``, ``short``) but not applied:
   candidates are not tested against it, they are verified in step 3.
3. Pairs are verified on whole texts. First each set is held against the one
   with which it shares most among the sets that lead its shingles, those whose
   own shingles are the most common (the text that copies were made from) and
   then any others; what is connected by then needs no further pairs within, so
   a large group of copies costs a pair for each member. Then all links across
   the components so far are counted, from the smaller component's side alone.

Components are those of all links: a pair inside a component needs no check to
keep it one. Defined cases: null and empty texts have no shingles and are alone;
a text of fewer than five words is one shingle of all its words; equal sets are
linked; rows with a null id count for their group but never name it (a group of
such rows alone has a null name); an empty input gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import BLOCK, NO_ID, SENT, counted, pack_texts, parts_for, sent, texts_of, told, unpack, unpack_counts, with_answers, write_blocks
from tessera.llm.common import give_back, let_go, persist_gathered, persist_table
from tessera.llm.components import connected
from tessera.llm.textwindows import Batch, mix, window_hashes
from tessera.operators.sizing import broadcast_if_small

SHINGLE = 5
EXTRA = 0.08  # of a set's size: how far a prefix may be lengthened
CHUNK, CLASS = 256, 4096
AT_ONCE = 100
GAIN = 1.0  # shingles more for each doubling of the estimated candidate cost
KEYS_PER_BYTE = 0.05
LARGE = 4 << 20  # bytes of a table of counts after which a worker hands memory back
REPS = 1 << 20  # level of the answers that tell which rows stand for their set


def ceil_share(n: int, percent: int, whole: int = 100) -> int:
    """The least whole number that is ``percent / whole`` of ``n`` or more."""
    return -(-n * percent // whole)


def longest_match(n: int, percent: int) -> int:
    """The most shared shingles that a lengthened prefix of a set of ``n`` may ask for."""
    return min(ceil_share(n, percent), 1 + int(np.ceil(EXTRA * n)))


def prefix_length(n: int, percent: int, match: int) -> int:
    return n - ceil_share(n, percent) + match


def needed(n: int, percent: int) -> int:
    """What a set must share with others within its longest prefix to have any partner."""
    return min(longest_match(n, percent), longest_match(ceil_share(n, percent), percent))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; ``AT_ONCE`` texts are read at a time, as some
    dozens of bytes are held for each byte read."""
    out = []
    for lo in range(0, len(texts), AT_ONCE):
        batch = Batch(texts[lo:lo + AT_ONCE], lower=True)
        whole = window_hashes(batch.hashes, size)
        for a, b in zip(batch.first[:-1].tolist(), batch.first[1:].tolist()):
            if b - a >= size:
                out.append(np.unique(whole[a:b - size + 1]))
            elif b > a:
                out.append(mix(window_hashes(batch.hashes[a:b], b - a) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit name of the set."""
    n = np.uint64(len(shingles))
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles + n).sum(dtype=np.uint64) + n], np.uint64)).view(np.int64)[0])


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, checked on whole texts."""
    def check(batches):
        let_go()
        for batch in batches:
            good_a, good_b = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for lo in range(0, len(columns[0]), 200):
                a, b, n_a, text_a, n_b, text_b = (c[lo:lo + 200] for c in columns)
                both = shingle_sets([pa.decompress(t, n, "zstd", asbytes=True) for t, n in zip(text_a + text_b, n_a + n_b)])
                for i in range(len(a)):
                    x, y = both[i], both[len(a) + i]
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        good_a.append(a[i])
                        good_b.append(b[i])
            del columns
            yield pa.RecordBatch.from_arrays([pa.array(good_a, pa.int64()), pa.array(good_b, pa.int64())], ["a", "b"])
        give_back()

    def side(name: str) -> DataFrame:
        return texts.select(F.col("node").alias(name), F.col("bytes").alias(f"bytes_{name}"), F.col("data").alias(f"data_{name}"))

    rows = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "bytes_a", "data_a", "bytes_b", "data_b")
    return persist_gathered(rows.mapInArrow(check, "a long, b long"), "links", "a")


def _texts(blocks: DataFrame) -> DataFrame:
    """node, bytes, data (compressed) of every text in blocks of sets."""

    def split(frames):
        let_go()
        for frame in frames:
            for r in frame.itertuples():
                nodes, texts = texts_of(r.ids, r.sizes, r.bytes, r.data)
                yield pd.DataFrame({"node": nodes, "bytes": [len(t) for t in texts], "data": [pa.compress(t, "zstd", asbytes=True) for t in texts]})
        give_back()

    return persist_table(blocks.mapInPandas(split, "node long, bytes long, data binary"), "set-texts", packed=True)


def _adapted(blocks: DataFrame, percent: int) -> DataFrame:
    """h, node, n, match, short, weight: the shared shingles of every set's adaptive prefix.

    ``match`` is what the set asks for, ``short`` tells the shingles that count
    when it is the smaller set of a pair, ``weight`` how common its shingles are.
    """
    parts = parts_for(blocks, 0.2)

    def ask(block, nodes, texts, by):
        keys, sets = np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_sets(texts)]), return_counts=True)
        return sent(block, keys, parts, sets.astype("<u4"))

    def prefixes(block, nodes, texts, by):
        sets = shingle_sets(texts)
        keys = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))
        sets_with = unpack_counts(by.get(0, {}), keys, parts)
        for node, s in zip(nodes.tolist(), sets):
            n = len(s)
            count = sets_with[np.searchsorted(keys, s)]
            order = np.lexsort((s, count))
            count = count[order]
            shortest, longest = prefix_length(n, percent, 1), longest_match(n, percent)
            cost = float((count[:shortest] - 1).sum())
            match = min(longest, 1 + int(np.log2(1 + cost / shortest) * GAIN))
            short = n - ceil_share(2 * n, percent, 100 + percent) + match
            weight = float(np.log2(count).mean())
            for rank in np.flatnonzero(count[:shortest - 1 + match] > 1).tolist():
                yield int(s[order[rank]].view(np.int64)), node, n, match, rank < short, weight

    answers = counted(with_answers(blocks, None, ask, SENT), 0)
    return persist_table(with_answers(blocks, answers, prefixes, "h long, node long, n int, match int, short boolean, weight double"), "prefixes")


def _components(blocks: DataFrame, percent: int) -> DataFrame:
    """node, component of the distinct sets that may have a partner."""
    postings, texts = _adapted(blocks, percent), _texts(blocks)
    labels = persist_gathered(texts.select("node", F.col("node").alias("component")), "components", "node")
    tried: DataFrame | None = None
    for lead in (F.max(F.struct("weight", "node", "n")), F.min(F.struct("node", "n"))):  # two first tries for each set
        centres = postings.groupBy("h").agg(lead.alias("c")).select("h", F.col("c.node").alias("centre"), F.col("c.n").alias("n_centre"))
        near = postings.join(centres, "h").where(
            (F.col("node") != F.col("centre")) & (100 * F.least("n", "n_centre") >= percent * F.greatest("n", "n_centre")))
        best = near.groupBy("node", "centre").agg(F.count(F.lit(1)).alias("k")).groupBy("node").agg(
            F.max_by("centre", F.struct("k", "centre")).alias("centre"))
        pairs = best.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        pairs = persist_table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        labels = connected(labels, _verified(pairs, texts, percent))
    named = persist_table(postings.join(labels, "node"), "named")
    met = named.groupBy("h").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low < _high").select("h")
    open_nodes = named.join(met, "h", "left_semi").select("node").distinct()
    waiting = persist_table(open_nodes.join(labels, "node"), "open")
    return connected(labels, _links_across(waiting, texts, percent))


def _links_across(waiting: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """All links (a, b) between ``waiting`` nodes of different components.

    Of two nodes the one in the smaller component (by size, then name) looks for
    the other. Nodes gather at the shingle that most of them have, those of a
    large component apart, in chunks of about ``CHUNK``; a chunk meets the nodes
    of larger components with which it shares shingles in classes of about
    ``CLASS`` by hash, counts what they share and gives out links alone. So a
    large component, which looks for nothing, costs no rows of its own.
    """

    def emit(batches):
        let_go()
        for batch in batches:
            nodes, components, members, sizes, data = (c.to_pylist() for c in batch.columns)
            for lo in range(0, len(nodes), 200):
                got = shingle_sets([pa.decompress(d, n, "zstd", asbytes=True) for d, n in zip(data[lo:lo + 200], sizes[lo:lo + 200])])
                n = [len(x) for x in got]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(x, np.int64), n)) for x in (
                    nodes[lo:lo + 200], components[lo:lo + 200], members[lo:lo + 200], n)] + [
                    pa.array(np.concatenate(got).view(np.int64))], ["node", "component", "members", "n", "h"])
        give_back()

    several = persist_table(waiting.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "several")
    sized = waiting.join(several, "component", "left").withColumn("members", F.coalesce("members", F.lit(1).cast("long")))
    rows = sized.join(texts, "node").select("node", "component", "members", "bytes", "data").mapInArrow(
        emit, "node long, component long, members long, n long, h long")
    every = persist_table(rows, "open-shingles")
    rank = F.struct("members", "component")
    shared = every.groupBy("h").agg(F.count(F.lit(1)).alias("sets"), F.min(rank).alias("_low"), F.max(rank).alias("high")).where(
        "_low < high").select("h", "sets", "high")
    rows = persist_table(every.join(shared, "h"), "open-postings")
    # a node's home: the shingle that most have, and its component if that is large
    first = persist_table(rows.groupBy("node").agg(F.max(F.struct("sets", "h")).alias("m"), F.first("members").alias("members"), F.first("component").alias("component")).select(
        F.col("node").alias("x"), F.col("m.h").alias("home"), F.when(F.col("members") >= CHUNK, F.col("component")).otherwise(0).alias("apart"),
        F.ceil(F.col("m.sets") / CLASS).alias("classes")), "first-homes")
    gathered = first.groupBy("home", "apart").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    home = persist_table(first.join(gathered, ["home", "apart"]).select(
        "x", F.xxhash64("home", "apart", F.pmod(F.xxhash64("x"), "chunks")).alias("chunk"), "classes"), "homes")
    wanted = rows.join(home, rows["node"] == home["x"]).groupBy("chunk", "h").agg(
        F.max("classes").alias("classes"), F.min(rank).alias("low"), F.first("high").alias("high")).where("low < high").select("chunk", "h", "classes", "low")
    met = wanted.join(rows.select("h", "node", "component", "n", rank.alias("rank")), "h").join(
        home.select("x", F.col("chunk").alias("own")), F.col("node") == F.col("x")).where(
        (F.col("chunk") == F.col("own")) | (F.col("rank") > F.col("low"))).select(
        "chunk", (F.col("chunk") == F.col("own")).alias("member"), "classes", "h", "node", "component", "n")
    # the members of a chunk go to each of its classes, any other node to its own
    spread = met.withColumn("class", F.explode(F.when(F.col("member"), F.sequence(F.lit(1), "classes")).otherwise(
        F.array(1 + F.pmod(F.xxhash64("node"), F.col("classes"))))))

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        let_go()
        nodes, first, of = np.unique(frame["node"].to_numpy(), return_index=True, return_inverse=True)
        n, component = frame["n"].to_numpy()[first], frame["component"].to_numpy()[first]
        member = np.zeros(len(nodes), bool)
        member[of[frame["member"].to_numpy(bool)]] = True
        rows_of = np.flatnonzero(member)
        place = np.cumsum(member) - 1
        common = np.zeros((len(rows_of), len(nodes)), np.int32)
        order = np.argsort(frame["h"].to_numpy(), kind="stable")
        h = frame["h"].to_numpy()[order]
        cuts = np.flatnonzero(np.diff(h)) + 1
        for at in np.split(of[order], cuts):
            common[np.ix_(place[at[member[at]]], at)] += 1
        large = common.nbytes > LARGE
        x, y = np.nonzero(100 * common.astype(np.int64) >= percent * (n[rows_of][:, None] + n[None, :] - common))
        x = rows_of[x]
        across = component[x] != component[y]
        a, b = np.minimum(nodes[x], nodes[y])[across], np.maximum(nodes[x], nodes[y])[across]
        del common, x, y, order, h
        if large:
            give_back()
        return pd.DataFrame({"a": a, "b": b})

    return persist_gathered(spread.groupBy("chunk", "class").applyInPandas(links, "a long, b long"), "links", "a")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, md5 (of the text), n_shingles, node, component of every row."""
    blocks = write_blocks(docs)
    parts = parts_for(blocks, KEYS_PER_BYTE)

    def describe(block, ids, texts, by):
        for i, s in enumerate(shingle_sets(texts)):
            yield None if ids[i] == NO_ID else int(ids[i]), hashlib.md5(texts[i], usedforsecurity=False).hexdigest(), block, i, len(s), set_key(s)

    rows = persist_gathered(with_answers(blocks, None, describe, "doc_id long, md5 string, block long, row int, n_shingles long, node long"), "sets", "block")
    reps = rows.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("block", "row")).alias("r")).groupBy("r.block").agg(
        F.sort_array(F.collect_list("r.row")).alias("rows"))  # rows of one block
    reps = reps.select("block", F.lit(REPS).alias("level"), F.explode("rows").alias("part"), F.lit(b"").alias("bits"))
    reps = reps.select("block", "level", F.col("part").cast("long").alias("part"), "bits")

    def zones(texts: list[bytes]):
        sets = shingle_sets(texts)
        cut = [s[:prefix_length(len(s), percent, longest_match(len(s), percent))] if len(s) else s for s in sets]
        names = np.array([set_key(s) for s in sets], np.int64)
        first = np.unique(names, return_index=True)[1]  # a block's equal sets send one prefix
        flat = np.concatenate([cut[i] for i in first]) if len(first) else np.empty(0, np.uint64)
        keys, counts = np.unique(flat, return_counts=True)
        return sets, cut, keys, counts > 1

    asked = told(with_answers(blocks, None, lambda block, ids, texts, by: sent(block, zones(texts)[2], parts), SENT), 0)

    def survivors(block, ids, texts, by):
        mine = by.get(REPS, {})
        if not mine:
            return
        sets, cut, keys, here = zones(texts)
        shared = here | unpack(by.get(0, {}), keys, parts)
        stay = [i for i in sorted(mine) if int(shared[np.searchsorted(keys, cut[i])].sum()) >= needed(len(sets[i]), percent)]
        if stay:
            yield pack_texts(block, [set_key(sets[i]) for i in stay], [texts[i] for i in stay])

    labels = _components(persist_table(with_answers(blocks, asked.unionByName(reps), survivors, BLOCK), "candidates", packed=True), percent)
    return rows.join(labels, "node", "left").select("doc_id", "md5", "n_shingles", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; the table is written."""
    named = _grouped(docs, percent)
    names = persist_table(named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("component_id")), "names")
    found = named.join(names, "component", "left")
    return persist_table(found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.col("component_id")).alias("component_id")), "near-duplicates")


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One document of each group of near duplicates; all columns unchanged.

    A document is an id with a text (by its MD5): of a group the one with the smallest
    id stays, of several texts of that id the one with the smallest MD5. Texts of one id
    that are not near duplicates all stay. Rows equal in id and text are one document;
    of these the row stays whose hash over all columns is smallest. Rows with a
    null id cannot be named and all stay, and so does every text without words.
    """
    known = _grouped(docs, percent).where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "md5").agg(
        F.first("component").alias("component"), F.count(F.lit(1)).alias("rows"))
    known = persist_table(known, "known")
    best = known.groupBy("component").agg(F.min(F.struct("doc_id", "md5")).alias("best"))
    dropped = known.join(best, "component").where(F.struct("doc_id", "md5") != F.col("best"))
    # sent to every task while it is small, so that texts cross no shuffle; a join by id and MD5 beyond that
    dropped = broadcast_if_small(persist_table(dropped.select(F.col("doc_id").alias("_gone"), F.col("md5").alias("_gone_md5")), "dropped"))
    md5 = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    kept = docs.join(dropped, (docs["doc_id"] == F.col("_gone")) & (md5 == F.col("_gone_md5")), "left_anti")
    twice = persist_table(known.where("rows > 1").select(F.col("doc_id").alias("_twice"), F.col("md5").alias("_twice_md5")), "repeated")
    if twice.isEmpty():
        return kept
    same = (kept["doc_id"] == F.col("_twice")) & (F.md5(F.coalesce(kept["text"], F.lit("")).cast("binary")) == F.col("_twice_md5"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = kept.join(twice, same).groupBy("_twice", "_twice_md5").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    return kept.join(twice, same, "left_anti").unionByName(once.select("_row.*"))

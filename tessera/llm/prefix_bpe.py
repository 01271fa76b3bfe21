"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a pre-token ends with one token, and only one: the
token that ends there, is its own encoding, and stays as it is next to the last token
of the prefix before it. So the tokens that end at a place are tried from the
longest on until one fits, the last token of each prefix is stored, and the ids are
read by following these back from the end. No merges are replayed over the text.

* Tokens that end at a place: a suffix automaton of all tokens follows the text;
  its state and match length name the longest token that ends here, and each
  token names the next shorter one that is its suffix.
* Whether two tokens stay as they are side by side: merges at the seam are taken
  back, the younger first, and no pair of symbols that meet there may merge
  before either is merged away from the seam. Answers are kept, in bounded number.

``tables`` works all this out from a tokenizer file on the driver, a few MB whatever
the corpus, and broadcasts it. Normalizer and pre-tokenizer are the file's own (by the
library where a piece is not plain, see ``tokens``); special tokens in a text are
found as the library finds them. Recurring pieces are encoded once and looked up.

Defined cases: a null text is empty and has no ids; rows repeat and ids may be null;
an empty input gives no rows. Files that the method does not cover (another model
than BPE, dropout, byte fallback, an unknown token, continuing prefixes, ignored merges,
added tokens that strip or are normalized, merges out of order) raise ValueError.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_a_time, kept
from tessera.llm.tokens import Encoder, byte_characters

NEVER = 1 << 30  # rank of a merge that does not come
ANSWERS = 1 << 19  # answers about pairs kept at a time


def suffix_automaton(words: list[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Moves, suffix links and longest lengths of the automaton of all factors of ``words``; state 0 is empty."""
    moves: list[dict[str, int]] = [{}]
    link, length = [-1], [0]

    def split(p: int, c: str, q: int) -> int:
        """A state of its own for the factors of ``q`` that are not longer than one more than those of ``p``."""
        if length[q] == length[p] + 1:
            return q
        moves.append(dict(moves[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy = len(moves) - 1
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        return copy

    for word in words:
        at = 0
        for c in word:
            if c in moves[at]:
                at = split(at, c, moves[at][c])
                continue
            moves.append({})
            link.append(0)
            length.append(length[at] + 1)
            new, p = len(moves) - 1, at
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                link[new] = split(p, c, moves[p][c])
            at = new
    return moves, link, length


class Pairs:
    """Which tokens stay as they are side by side."""

    def __init__(self, rank: array, left: array, right: array):
        self.rank, self.left, self.right = rank, left, right
        self.merged = {(a, b): r for a, b, r in zip(left, right, rank) if r >= 0}
        self.known: dict[int, bool] = {}

    def stay(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge of rank below ``until`` crosses the seam between tokens ``a`` and ``b``."""
        rank, merged = self.rank, self.merged
        a_goes = b_goes = until
        while True:
            r = merged.get((a, b))
            if r is not None and r < a_goes and r <= b_goes:  # of equal pairs the left one merges first
                return False
            if rank[a] > rank[b]:
                a_goes, a = rank[a], self.right[a]
            elif rank[b] >= 0:
                b_goes, b = rank[b], self.left[b]
            else:
                return True

    def __call__(self, a: int, b: int) -> bool:
        pair = a << 32 | b
        if (yes := self.known.get(pair)) is None:
            if len(self.known) >= ANSWERS:
                self.known.clear()
            yes = self.known[pair] = self.stay(a, b)
        return yes


def _refuse(what: str) -> None:
    raise ValueError(f"not covered: {what}")


def tables(path: str) -> dict:
    """What encoding and decoding need of a tokenizer file, as flat arrays."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    model, added = settings["model"], settings.get("added_tokens") or []
    if model.get("type") != "BPE":
        _refuse("a model other than BPE")
    for name in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"):
        if model.get(name):
            _refuse(name)
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        _refuse("added tokens that strip or are normalized")
    decoder = (settings.get("decoder") or {"type": None})["type"]
    if decoder not in (None, "ByteLevel"):
        _refuse(f"decoder {decoder}")
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    size = 1 + max([*vocab.values(), *(t["id"] for t in added)], default=-1)
    strings: list[str | None] = [None] * size
    for word, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]:
        strings[i] = word
    rank, left, right = (array("i", [-1]) * size for _ in range(3))
    symbols = {i: chr(k) for k, i in enumerate(sorted(i for w, i in vocab.items() if len(w) == 1 or end and len(w) == 1 + len(end) and w.endswith(end)))}
    spelt: list[str] = [symbols.get(i, "") for i in range(size)]
    for r, merge in enumerate(model["merges"]):
        a, b = (vocab[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
        t = vocab[strings[a] + strings[b]]
        if spelt[t] or not spelt[a] or not spelt[b]:
            _refuse("merges out of order")
        rank[t], left[t], right[t] = r, a, b
        spelt[t] = spelt[a] + spelt[b]
    pairs = Pairs(rank, left, right)
    own = [bool(s) for s in spelt]  # tokens that their own string is encoded to
    for t in sorted(range(size), key=rank.__getitem__):
        if rank[t] >= 0:
            own[t] = own[left[t]] and own[right[t]] and pairs.stay(left[t], right[t], rank[t])
    moves, link, length = suffix_automaton(sorted(s for s, yes in zip(spelt, own) if yes))
    at: dict[int, list[int]] = {}
    for t, yes in enumerate(own):
        if yes:
            state = 0
            for c in spelt[t]:
                state = moves[state][c]
            at.setdefault(state, []).append(t)
    top, shorter = array("i", [-1]) * len(moves), array("i", [-1]) * size
    for state in sorted(range(1, len(moves)), key=length.__getitem__):
        below = top[link[state]]
        for t in sorted(at.get(state, ()), key=lambda t: len(spelt[t])):
            shorter[t] = below
            below = t
        top[state] = below
    begin = array("i", [0])
    for m in moves:
        begin.append(begin[-1] + len(m))
    middle = {w: symbols[i] for w, i in vocab.items() if len(w) == 1}
    return {"strings": strings, "rank": rank, "left": left, "right": right, "sizes": array("i", map(len, spelt)),
            "begin": begin, "labels": "".join(c for m in moves for c in m), "target": array("i", [q for m in moves for q in m.values()]),
            "link": array("i", link), "length": array("i", length), "top": top, "shorter": shorter,
            "middle": middle, "last": {w[0]: symbols[i] for w, i in vocab.items() if len(w) == 1 + len(end) and w.endswith(end)} if end else middle,
            "token_of": {c: i for i, c in symbols.items()}, "added": {t["content"]: t["id"] for t in added}, "decoder": decoder}


class PrefixBPE:
    """Ids of one pre-token."""

    def __init__(self, parts: dict):
        self.parts = parts
        self.stay = Pairs(parts["rank"], parts["left"], parts["right"])

    def spell(self, piece: str) -> str:
        """Symbols of a pre-token; characters without one are left out."""
        middle, last = self.parts["middle"], self.parts["last"]
        return "".join([middle.get(c, "") for c in piece[:-1]]) + last.get(piece[-1:], "")

    def __call__(self, word: str) -> list[int]:
        p = self.parts
        find, begin, target, link, length = p["labels"].find, p["begin"], p["target"], p["link"], p["length"]
        top, shorter, sizes, stay = p["top"], p["shorter"], p["sizes"], self.stay
        last = [-1]  # the last token of each prefix
        state = matched = 0
        for i, c in enumerate(word, 1):
            while (k := find(c, begin[state], begin[state + 1])) < 0:
                state = link[state]
                matched = length[state]
            state, matched = target[k], matched + 1
            token = top[state]
            while sizes[token] > matched:
                token = shorter[token]
            while (before := i - sizes[token]) and not stay(last[before], token):
                token = shorter[token]
            last.append(token)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= sizes[last[i]]
        return out[::-1]


class PrefixEncoder(Encoder):
    """Whole texts to ids, each pre-token by ``PrefixBPE``."""

    def __init__(self, path: str, parts: dict, cache_bytes: int = 48 << 20):
        super().__init__(path, cache_bytes=cache_bytes)
        self.dynamic = PrefixBPE(parts)
        self.bytes_ = {b: c for b, c in byte_characters().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(parts["added"], key=len, reverse=True))) + ")") if parts["added"] else None

    def _chain(self, text: str) -> list[int]:
        """Ids of a text by the file's own normalizer and pre-tokenizer."""
        normalizer, before = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        words = [w for w, _ in before.pre_tokenize_str(text)] if before else [text] if text else []
        return [i for w in words for i in self.dynamic(self.dynamic.spell(w))]

    def _learn(self, parts: list[str], plain: list[bool]) -> list[list[int]]:
        spell, ids, table = self.dynamic.spell, self.dynamic, self.bytes_
        return [ids(spell(part.encode().decode("latin-1").translate(table))) if one else self._chain(part) for part, one in zip(parts, plain)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(self._chain(t), "<u4").tobytes() for t in texts]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.special is None or not any(t and self.special.search(t) for t in texts):
            return super().__call__(texts)
        split = [self.special.split(t or "") for t in texts]  # text, special token, text, ...
        got = iter(super().__call__([part for parts in split for part in parts[::2]]))
        added = self.dynamic.parts["added"]
        return [b"".join(np.uint32(added[x]).astype("<u4").tobytes() if k % 2 else next(got) for k, x in enumerate(parts)) for parts in split]


def decoder(parts: dict):
    """ids -> text: token strings joined by spaces, or their bytes in byte-level files; unknown ids are left out."""
    strings = parts["strings"]
    if parts["decoder"] is None:
        return lambda ids: " ".join([s for i in ids if 0 <= i < len(strings) and (s := strings[i]) is not None])
    back = {c: b for b, c in byte_characters().items()}

    def raw(s: str) -> bytes:
        try:
            return bytes([back[c] for c in s])
        except KeyError:
            return s.encode()

    pieces = [b"" if s is None else raw(s) for s in strings]
    return lambda ids: b"".join([pieces[i] for i in ids if 0 <= i < len(pieces)]).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """Ids of every whole text: key, ids, and with ``with_text`` what they decode to."""
    sent = docs.sparkSession.sparkContext.broadcast(tables(tokenizer))

    def encode(batches):
        encoder = kept(("prefixes", tokenizer), lambda: PrefixEncoder(tokenizer, sent.value))
        read = decoder(sent.value)
        for batch in few_at_a_time(batches):
            ids = [np.frombuffer(x, "<u4") for x in encoder(batch.column(1).to_pylist())]
            ends = np.cumsum([0, *map(len, ids)])
            out = {"key": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, "<u4"), *ids]).astype(np.int32)))}
            if with_text:
                out["decoded"] = [read(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_pydict(out)

    schema = "key long, ids array<int>" + ", decoded string" * with_text
    return docs.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(encode, schema).withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id lists: key, decoded. A null list gives a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(tables(tokenizer))

    def decode(batches):
        read = decoder(sent.value)
        for batch in few_at_a_time(batches):
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "decoded": pa.array(
                [None if x is None else read([i for i in x if i is not None]) for x in batch.column(1).to_pylist()], pa.string())})

    return encoded.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(
        decode, "key long, decoded string").withColumnRenamed("key", key)

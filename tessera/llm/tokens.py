"""Ids of whole texts by a public tokenizer, with a bounded cache of recurring pieces.

The tokenizers library merges within pre-tokens alone, so a text may be cut
wherever its pre-tokenizer always cuts, and the parts encoded one by one:

* ``words``: at ASCII white space, for tokenizers that drop white space;
* ``spaces``: before a space that stands before a character that is no white
  space, for byte-level ones whose pre-tokens take one leading space along.

Parts recur often, so each is encoded by the library once and then looked up for
a whole batch in numpy (``piece_cache``). Most parts are Latin letters and ASCII
signs, whose pre-tokens are plain to see: their letters are handed to the
library's model without the rest of its chain, which costs most of the time on
short strings. Both short cuts are taken only where the file's own normalizer and
pre-tokenizer are the two known here; texts of any other tokenizer go to the
library whole. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from tessera.llm.common import kept
from tessera.llm.piece_cache import PieceCache, piece_names
from tessera.llm.textwindows import word_bounds

GROUP = 1 << 22  # bytes encoded together

# Bytes after which a space may not be cut: white space, its look-alikes, and the
# first bytes of longer white space characters. Not to cut is always right.
_CUT = np.ones(256, bool)
_CUT[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = False

# Kinds of bytes. Letters are A-Z, a-z and the two-byte ones from À to ÿ, one
# character in either case and in NFC; signs are ASCII without the apostrophe, which
# starts contractions. A part with any odd byte stays whole.
_LETTER, _SIGN, _BREAK, _SPACE, _ODD = 1, 2, 3, 4, 5
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[c for c in range(0x21, 0x7F) if c != 0x27 and not 0x30 <= c <= 0x39]] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x0A], _KIND[0x20] = _BREAK, _SPACE
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True  # second bytes; without the signs of multiplication and division


def _spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A mask of the bytes of these spans."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself
    where it prints, else the next one from 256 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Settings of tokenizer files whose parts may be encoded one by one.
_KNOWN = {
    "words": {
        "normalizer": {"type": "Sequence", "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
             "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}},
    "spaces": {
        "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}},
}


def known_cut(path: str) -> str | None:
    """How texts of this tokenizer file may be cut; None where the file's settings are not known."""
    with open(path, encoding="utf-8") as f:
        settings = json.load(f)
    added = [t for t in settings.get("added_tokens") or [] if not t["special"]]
    for cut, want in _KNOWN.items():
        if not added and settings["model"].get("type") == "BPE" and all(settings.get(k) == v for k, v in want.items()):
            return cut
    return None


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, cut: str | None = None, cache_bytes: int = 48 << 20):
        self.cut = known_cut(path)
        if cut not in (None, self.cut):
            raise ValueError(f"texts of {path} cannot be cut at {cut}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on every core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.signs = lru_cache(4096)(self._ids)  # the few signs and line breaks after words
        self.stands = byte_characters()
        self.space = self.stands[0x20]
        self.cache = PieceCache(self.tokenizer.get_vocab_size(), cache_bytes)

    def _cuts(self, view: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the parts of texts that begin there."""
        if self.cut == "words":
            return word_bounds(view)
        begins = np.unique(begins[begins < len(view)])
        here = np.zeros(len(view) + 1, bool)
        spaces = np.flatnonzero(view[:-1] == 0x20)
        here[spaces[_CUT[view[spaces + 1]]]] = True
        here[begins - 1] = False  # a space that ends a text is not cut from those before it
        here[begins] = True
        starts = np.flatnonzero(here[:-1])
        return starts, np.append(starts[1:], len(view))[:len(starts)]

    def _pieces(self, view: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all texts: starts, ends, which are plain (one pre-token each), and the bytes, plain ones in lower case if case goes."""
        starts, ends = self._cuts(view, begins)
        kind = _KIND[view]
        lead = np.flatnonzero(view[:-1] == 0xC3)
        lead = lead[_LATIN[view[lead + 1]]]
        kind[lead] = kind[lead + 1] = _LETTER
        odd = kind == _ODD
        if self.cut == "spaces":  # white space is plain as one space before a sign or letter, or as one line break
            blank = (kind == _BREAK) | (kind == _SPACE)
            odd |= kind == _SPACE
            odd[1:] |= blank[1:] & blank[:-1]
            first = starts[(kind[starts] == _SPACE) & (ends - starts > 1)]
            first = first[kind[first + 1] <= _SIGN]
            odd[first] = False
            kind[first] = kind[first + 1]
        found = np.concatenate([[0], np.cumsum(odd)])
        plain = found[ends] == found[starts]
        inside = _spread(starts[plain], ends[plain], len(view))
        edge = np.zeros(len(view), bool)
        edge[1:] = inside[1:] & (kind[1:] != kind[:-1])
        edge[starts] = True
        stop = np.zeros(len(view) + 1, bool)
        stop[ends] = True
        stop[1:-1] |= inside[:-1] & edge[1:]
        if self.cut == "words":
            view = view.copy()
            view[inside & (view >= 0x41) & (view <= 0x5A)] += 0x20
            upper = lead[inside[lead] & (view[lead + 1] < 0x9F)] + 1
            view[upper] += 0x20
        starts = np.flatnonzero(edge)
        return starts, np.flatnonzero(stop), inside[starts], view

    def _plain(self, piece: str) -> list[int]:
        """Ids of one plain pre-token, from the model alone."""
        if not piece[-1].isalpha():
            return self.signs(piece.translate(self.stands))
        if not piece.isascii():
            piece = piece.encode().decode("latin-1")
            return self._ids(piece.translate(self.stands))
        return self._ids(self.space + piece[1:] if piece[0] == " " else piece)

    def _ids(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _learn(self, parts: list[str], plain: list[bool]) -> list[list[int]]:
        out = [self._plain(part) if one else [] for part, one in zip(parts, plain)]
        odd = [k for k, one in enumerate(plain) if not one]
        for k, got in zip(odd, self.tokenizer.encode_batch_fast([parts[k] for k in odd], add_special_tokens=False)):
            out[k] = got.ids
        return out

    def _group(self, texts: list[bytes]) -> list[bytes]:
        gap = b"\n" if self.cut == "words" else b""
        data = gap.join(texts)
        begins = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
        starts, ends, plain, view = self._pieces(np.frombuffer(data, np.uint8), begins[:-1])
        names, checks = piece_names(view, starts, ends)
        lowered = view.tobytes()

        def learn(at):
            return self._learn([lowered[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())], plain[at].tolist())

        flat, n = self.cache(names, checks, learn)
        bounds = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(starts, begins)].tolist()
        flat = flat.astype("<u4")
        return [flat[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may not be cut."""
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if self.cut is None:
            return self._whole([t or "" for t in texts])
        out: list[bytes] = []
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append((text or "").encode("utf-8", "replace"))
            size += len(group[-1])
            if size >= GROUP:
                out += self._group(group)
                group, size = [], 0
        return out + (self._group(group) if group else [])


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, stage and file, so that its cache outlives a batch."""
    return kept(("encoder", path), lambda: Encoder(path))

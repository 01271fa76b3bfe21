"""Secret scan: all rules in one automaton over the bytes of a text.

The rules' regular expressions are parsed, turned into one non-deterministic
automaton that may start a match at any byte, made deterministic by subset
construction over byte classes and minimised by partition refinement. A text is
read once, a list look-up for each byte; only texts in which the automaton
reaches an accepting state are read again for the rules that were hit, whose
expressions then give the exact spans (leftmost, not overlapping within a rule).

A rule's tail may have to be longer than the automaton counts: ``Rule.seen`` is
the number of tail characters that the automaton waits for, ``Rule.least`` the
number that the exact check asks for. ``seen <= least``, so nothing is missed.

Defined cases: null and empty texts have no spans; spans count code points, the
end is exclusive; equal rows are judged alike, each for itself; an empty input
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import reduce
from operator import getitem
from re import _constants as codes  # type: ignore[attr-defined]
from re import _parser as parser  # type: ignore[attr-defined]

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_a_time


@dataclass(frozen=True)
class Rule:
    """``head``, then a run of ``tail`` characters (a group of that name), then ``rest``, which only the exact check reads and which may be empty."""

    kind: str
    head: str
    tail: str
    least: int
    seen: int
    rest: str = ""

    @property
    def exact(self) -> re.Pattern:
        return re.compile(f"{self.head}(?P<tail>{self.tail}+){self.rest}")

    @property
    def scanned(self) -> str:
        return f"{self.head}(?:{self.tail}){{{self.seen},{self.seen}}}"


# The patterns of the base rules, then those that the method adds.
BASE = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 12, 4),
    Rule("access", "AKIA", "[A-Z0-9]", 14, 4),
    Rule("hex", "", "[0-9a-f]", 16, 16),
)
# What follows a key's header: fields, then base64 up to the END line, or if there is none to the last base64 line. Line ends may
# be written as \n, lines quoted or indented. Nothing is tried twice (possessive), so the time is linear in the text.
_BETWEEN = r"""(?:\\+[nrt]?|[\s>#*|"',])"""
_FIELD = r"(?:Proc-Type:\x20?\d,[A-Z]+|DEK-Info:\x20?[A-Z0-9-]+,[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9-]{2,30}:\x20[^\n\\]{0,200}+(?=\n|\\))"
_BODY = (rf"(?:(?:{_BETWEEN}*+{_FIELD})*+"
         r"""(?:[A-Za-z0-9+/=\s\\>#*|"',]*+-----END (?:[A-Z0-9]+ ){0,2}?PRIVATE KEY(?: BLOCK)?-*+"""
         rf"|(?:{_BETWEEN}++[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++"
         r"""(?:["'\x20\t\r]*+(?:\n|\\+n)[\x20\t>#*|"']*+=?[A-Za-z0-9+/]+={0,2}(?=[\x20\t\r]*+(?:[\n"'\\]|\Z))){0,2}))?""")
ADDED = (
    Rule("pem", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?", "-", 5, 5, _BODY),
    Rule("github", "gh[opsur]_", "[A-Za-z0-9]", 20, 4),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 20, 4),
)
RULES = BASE + ADDED


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def bytes_of(self, op, value, any_case: bool) -> frozenset[int]:
        if op is codes.LITERAL:
            got = {value}
        elif op is codes.IN:
            got = set()
            for kind, x in value:
                got |= set(range(x[0], x[1] + 1)) if kind is codes.RANGE else {x}
        else:
            raise ValueError(f"not supported in a rule: {op}")
        if any_case:
            got |= {ord(c) for b in got if chr(b).isalpha() for c in (chr(b).lower(), chr(b).upper())}
        if any(b > 127 for b in got):
            raise ValueError("rules are of ASCII characters")
        return frozenset(got)

    def add(self, tree, at: int, any_case: bool = False) -> int:
        """Appends a parsed expression behind state ``at``; returns the state behind it."""
        for op, value in tree:
            if op is codes.SUBPATTERN:
                at = self.add(value[3], at, any_case or bool(value[1] & re.IGNORECASE))
            elif op is codes.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, at, any_case)].append(end)
                at = end
            elif op is codes.MAX_REPEAT:
                low, high, part = value
                for _ in range(low):
                    at = self.add(part, at, any_case)
                if high is codes.MAXREPEAT:
                    loop = self.state()
                    self.free[at].append(loop)
                    self.free[self.add(part, loop, any_case)].append(loop)
                    at = loop
                else:
                    end = self.state()
                    for _ in range(high - low):
                        self.free[at].append(end)
                        at = self.add(part, at, any_case)
                    self.free[at].append(end)
                    at = end
            else:
                after = self.state()
                self.moves[at].append((self.bytes_of(op, value, any_case), after))
                at = after
        return at


def compile_rules(rules: tuple[Rule, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Transition array (states x 256) and, for each state, the bits of the rules that match on reaching it. State 0 starts."""
    nfa, start, ends = _Nfa(), 0, {}
    nfa.state()
    for k, rule in enumerate(rules):
        ends[nfa.add(parser.parse(rule.scanned), start)] = 1 << k

    def closed(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in nfa.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    kinds: dict[tuple, int] = {}
    sets = sorted({m[0] for moves in nfa.moves for m in moves}, key=sorted)
    of_byte = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    sample = [int(np.flatnonzero(of_byte == k)[0]) for k in range(len(kinds))]

    first = closed([start])
    number, todo, table = {first: 0}, [first], []
    for subset in todo:  # grows meanwhile
        row = []
        for b in sample:
            after = closed({t for s in subset for on, t in nfa.moves[s] if b in on} | {start})
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        table.append(row)
    moves = np.array(table)
    bits = np.array([sum({ends[s] for s in subset if s in ends}) for subset in todo])

    group = np.unique(bits, return_inverse=True)[1]
    while True:  # split groups until states of a group move to the same groups
        finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = np.concatenate([[group[0]], np.setdiff1d(np.arange(group.max() + 1), group[:1])])
    place = np.argsort(order)
    keep = np.array([np.flatnonzero(group == g)[0] for g in order])
    return place[group[moves[keep]]][:, of_byte].astype(np.int32), bits[keep]


class Scanner:
    """The automaton as linked lists, made from the arrays in each worker."""

    def __init__(self, rules: tuple[Rule, ...], moves: np.ndarray, bits: np.ndarray):
        self.rules = [(r.kind, r.exact, r.least) for r in rules]
        self.start = self._linked(moves, bits)
        self.found: list = []
        self.found += [self.found] * 256  # a state that is never left
        self.quick = self._linked(moves, bits, self.found)

    @staticmethod
    def _linked(moves, bits, found=None) -> list:
        states: list[list] = [[] for _ in bits]
        for state, row, own in zip(states, moves.tolist(), bits.tolist()):
            state += [found if found is not None and bits[t] else states[t] for t in row]
            state.append(own)
        return states[0]

    def hits(self, data: bytes) -> int:
        """Bits of the rules that match somewhere."""
        if reduce(getitem, data, self.quick) is not self.found:
            return 0
        state, hit = self.start, 0
        for b in data:
            state = state[b]
            hit |= state[256]
        return hit

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches that are long enough, in order."""
        hit = self.hits(text.encode("utf-8", "replace"))
        out = []
        for k, (_, exact, least) in enumerate(self.rules):
            if hit >> k & 1:
                out += [(m.start(), k, m.end()) for m in exact.finditer(text) if m.end("tail") - m.start("tail") >= least]
        return sorted(out)


def _scanner(rules: tuple[Rule, ...]):
    """A function that gives the worker's scanner; only the arrays travel."""
    moves, bits = compile_rules(rules)
    held: list[Scanner] = []

    def get() -> Scanner:
        if not held:
            held.append(Scanner(rules, moves, bits))
        return held[0]

    return get


def scan_documents(docs: DataFrame, key: str = "doc_id", base: int = len(BASE), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: key, n_<kind> of the base rules, base_sha256, spans (kind:start:end by start, then rule)."""
    scanner = _scanner(rules)
    kinds = [r.kind for r in rules]
    schema = ", ".join(f"n_{k} long" for k in kinds[:base]) + ", base_sha256 string, spans string"

    names = [key, *(f"n_{k}" for k in kinds[:base]), "base_sha256", "spans"]

    def scan(batches):
        scan_one = scanner().spans
        for batch in few_at_a_time(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                spans = scan_one(t or "")
                said = [f"{kinds[k]}:{a}:{b}" for a, k, b in spans]
                own = ",".join(s for s, (_, k, _) in zip(said, spans) if k < base)
                rows.append([sum(k == j for _, k, _ in spans) for j in range(base)] + [hashlib.sha256(own.encode()).hexdigest(), ",".join(said)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, zip(*rows))], names)

    return docs.select(F.col(key).cast("long"), "text").mapInArrow(scan, f"{key} long, {schema}")


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every found span replaced by ``mark`` (overlapping spans by one); n_chars follows the text."""
    scanner = _scanner(rules)

    place = docs.columns.index("text")

    def clean_one(t: str | None) -> str | None:
        spans, parts, at = (scanner().spans(t) if t else []), [], 0
        for a, _, b in spans:
            if a >= at:
                parts += [t[at:a], mark]
            at = max(at, b)
        return "".join(parts) + t[at:] if spans else t

    def clean(batches):
        for batch in few_at_a_time(batches):
            texts = pa.array([clean_one(t) for t in batch.column(place).to_pylist()], batch.schema.field(place).type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    out = docs.mapInArrow(clean, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out

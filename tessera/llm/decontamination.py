"""Benchmark decontamination by template windows.

Words lose the punctuation around them and their case; numbers (in figures or
words), units and names become typed placeholders whose values are kept as slots. A
capitalised word is a name unless the benchmark has it in lower case somewhere, so a
sentence's first word is read alike in document and item; names that follow one
another without punctuation are one placeholder. Windows of ``WINDOW`` template words
are hashed, doubling from single words, and joined with the benchmark's windows:

* with ``LITERAL`` literal words or more, by their template. Matched windows that lie
  equally far apart in document and item are one occurrence, and a pair of document
  and item counts if the slots of any occurrence are consistent, that is every
  benchmark value stands for one value throughout it, as in a question with other
  numbers or names;
* an item's windows with fewer, by their words as they are, so that an exact copy is
  found whatever it is made of.

An item shorter than a window is one window of all its words, by its template with
``SHORT_LITERAL`` literal words or more; one of fewer than ``SHORT`` words is
found only where it is the whole document. Windows whose words and slot values are the
same on both sides are matches as they are.

Texts are read many at a time in numpy; only matched windows become rows. Which words the
benchmark has in lower case goes to every task as a bitmap of fixed size; two words
that share a bit are at worst both literal, in document and item alike.

Defined cases: null and empty texts match nothing, nor do items without a word; a
window that several items share counts for each of them; rows with a null id are left
out of the result (they cannot be named); equal documents are each reported under
their ids, rows of one id as one document; other columns do not matter.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_a_time, persist_table
from tessera.llm.textwindows import mix, window_hashes, word_bounds, word_hashes

WINDOW, LITERAL = 8, 4
SHORT, SHORT_LITERAL = 5, 3
PREFILTER = 2_000_000  # benchmark windows (16 MB) that may be sent to every task
BITS = 1 << 22  # of the bitmap of common words
# Words taken for units.
UNITS = frozenset("""mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres kilometer kilometers
mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons
s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
dollar dollars euro euros cent cents usd eur percent % $ € £ mph kmh km/h w kw kwh v j kj hz""".split())
# Words taken for numbers, in English, French, German and Spanish, without those that are articles too.
NUMBERS = frozenset("""zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend
cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta cien mil""".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?\Z")
_AROUND = ".,;:!?\"'()[]{}«»„“”‘’…"
_SLOT = mix(np.arange(11, 15, dtype=np.uint64))  # codes of number, unit, name
_AS_IS = np.uint64(0xA0761D6478BD642F)  # tells windows of words as they are from templates
_STRIPPED = np.zeros(256, bool)
_STRIPPED[[ord(c) for c in _AROUND if c < "\x80"]] = True
_FIGURE = np.zeros(256, bool)
_FIGURE[0x30:0x3A] = True
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True  # second bytes of the letters from À to ÿ


def _hashes_of(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"\n".join(words) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    return word_hashes(data, starts, starts + sizes)


_UNIT_HASHES = np.sort(_hashes_of([w.encode() for w in sorted(UNITS)]))
_NUMBER_HASHES = np.sort(_hashes_of([w.encode() for w in sorted(NUMBERS)]))


def _among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _bit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(17)).astype(np.int64) & (BITS - 1)


def odd_word(word: bytes) -> tuple[bytes, bool, bool, bool, int, int]:
    """Of a word that is not plain: its bare form in lower case, whether it is a number, looks like a name, is
    in lower case, and how many bytes were stripped before and after."""
    text = word.decode("utf-8", "replace")
    left = text.lstrip(_AROUND)
    bare = left.rstrip(_AROUND)
    name = bare[:1].isupper() and not (len(bare) > 1 and bare.isupper())
    return bare.lower().encode("utf-8", "replace"), bool(_NUMBER.match(bare)), name, bare == bare.lower(), len(text) - len(left), len(left) - len(bare)


class Templates:
    """Template words of many texts end to end.

    ``first[i]:first[i + 1]`` are those of text i; ``literal`` has the hash of each
    word as it is (of a run of names, of them all), ``kind`` 0 for a literal, 1 number, 2 unit,
    3 name, and ``template`` the hash of the literal or placeholder.
    """

    def __init__(self, texts: list[bytes], common: np.ndarray | None):
        self.data = b"\n".join(texts)
        view = np.frombuffer(self.data, np.uint8)
        starts, ends = word_bounds(view)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        low = view.copy()
        upper = (view >= 0x41) & (view <= 0x5A)
        low[upper] += 0x20
        high = view >= 0x80
        lead = np.flatnonzero(view[:-1] == 0xC3)
        lead = lead[_LATIN[view[lead + 1]]]
        high[lead] = high[lead + 1] = False
        capital = lead[view[lead + 1] < 0x9F]  # ß has no capital here
        upper[capital] = True
        low[capital + 1] += 0x20

        def any_in(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask)])
            return sums[b] > sums[a]

        a, b = starts.copy(), ends.copy()
        open_ = np.flatnonzero(_STRIPPED[view[a]]) if len(a) else np.empty(0, np.int64)
        while len(open_):
            a[open_] += 1
            open_ = open_[a[open_] < b[open_]]
            open_ = open_[_STRIPPED[view[a[open_]]]]
        open_ = np.flatnonzero((b > a) & _STRIPPED[view[b - 1]]) if len(b) else np.empty(0, np.int64)
        while len(open_):
            b[open_] -= 1
            open_ = open_[a[open_] < b[open_]]
            open_ = open_[_STRIPPED[view[b[open_] - 1]]]
        literal = word_hashes(low, a, b)
        letters = np.zeros(len(view), bool)
        letters[(low >= 0x61) & (low <= 0x7A)] = True
        letters[lead] = True
        in_lower = ~any_in(upper, a, b)
        one = b - a == np.where(view[np.minimum(a, max(0, len(view) - 1))] == 0xC3, 2, 1) if len(a) else np.zeros(0, bool)
        name = np.zeros(len(a), bool)
        some = b > a
        name[some] = upper[a[some]]
        name &= one | any_in(letters & ~upper, a, b)
        number = _among(literal, _NUMBER_HASHES)
        odd = np.flatnonzero(any_in(high | _FIGURE[view], starts, ends))
        before, after = a > starts, ends > b
        if len(odd):
            raw = [self.data[x:y] for x, y in zip(starts[odd].tolist(), ends[odd].tolist())]
            distinct = {w: k for k, w in enumerate(dict.fromkeys(raw))}
            read = [odd_word(w) for w in distinct]
            of = np.fromiter(map(distinct.__getitem__, raw), np.int64, len(raw))
            literal[odd] = _hashes_of([r[0] for r in read])[of]
            flags = np.array([(r[1], r[2], r[3], r[4] > 0, r[5] > 0) for r in read], bool)[of]
            number[odd] = flags[:, 0] | _among(literal[odd], _NUMBER_HASHES)
            name[odd], in_lower[odd], before[odd], after[odd] = flags[:, 1], flags[:, 2], flags[:, 3], flags[:, 4]
        self.in_lower = literal[in_lower & ~number]  # what makes a word common
        kind = np.where(number, 1, np.where(_among(literal, _UNIT_HASHES), 2, 0)).astype(np.int8)
        if common is not None and len(kind):
            bits = _bit(literal)
            name &= (common[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 0
        kind[(kind == 0) & name] = 3
        text_first = np.searchsorted(starts, begin)
        goes_on = np.zeros(len(kind), bool)
        goes_on[1:] = (kind[1:] == 3) & (kind[:-1] == 3) & ~after[:-1] & ~before[1:]
        goes_on[text_first[:-1][text_first[:-1] < len(kind)]] = False
        at = np.flatnonzero(~goes_on)
        self.literal = literal[at]
        more = np.flatnonzero(goes_on)
        for step, k in zip(more.tolist(), (np.searchsorted(at, more) - 1).tolist()):  # a run of names is one word
            self.literal[k] = mix(self.literal[k:k + 1] + literal[step])[0]
        self.kind = kind[at]
        self.template = np.where(self.kind > 0, _SLOT[self.kind], self.literal)
        self.first = np.searchsorted(at, text_first)
        self._span = (a[at], b[np.append(at[1:], len(kind))[:len(at)] - 1])

    def windows(self, size: int, literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows of ``size`` by template and as they are, which may match by template, and which lie inside one text."""
        by_template, as_is = window_hashes(self.template, size), window_hashes(self.literal, size)
        plain = np.concatenate([[0], np.cumsum(self.kind == 0)])
        n = len(by_template)
        templated = plain[size:size + n] - plain[:n] >= literal
        inside = np.ones(n, bool)
        for back in range(1, size):
            border = self.first[1:-1] - back
            inside[border[(border >= 0) & (border < n)]] = False
        tag = np.uint64(size)
        return mix(by_template + tag), mix((as_is ^ _AS_IS) + tag), templated, inside

    def value(self, k: int) -> str:
        """What a slot holds: its words in lower case."""
        return self.data[self._span[0][k]:self._span[1][k]].decode("utf-8", "replace").strip(_AROUND).lower()


def _windows(df: DataFrame, key: str, wanted: np.ndarray | None, common: np.ndarray | None, short: list[int], whole: bool) -> DataFrame:
    """Rows h, key, copy, at, slots (kind=value) of windows, or of those in the sorted array ``wanted``.

    ``copy`` tells texts of one key apart. Of windows of the sizes in ``short``, all are meant, or
    (``whole``, for the benchmark) those that are whole texts.
    """
    schema = f"h long, {key} long, copy long, at long, slots array<string>"
    names = [c.split()[0] for c in schema.split(", ")]

    def emit(batches):
        for batch in few_at_a_time(batches, 100):
            keys, copies, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            read = Templates([b"" if k is None else (t or "").encode("utf-8", "replace") for k, t in zip(keys, texts)], common)
            lengths = np.diff(read.first)
            rows: list[tuple] = []
            for size in [WINDOW, *short]:
                by_template, as_is, templated, inside = read.windows(size, LITERAL if size == WINDOW else SHORT_LITERAL)
                text = np.searchsorted(read.first, np.arange(len(inside)), "right") - 1
                if size < SHORT or (whole and size < WINDOW):
                    inside = inside & (lengths[text] == size)
                for hashes, counts, slotted in ((by_template, inside & templated, True), (as_is, inside & ~templated if whole else inside, False)):
                    if wanted is not None:
                        counts = counts & _among(hashes, wanted)
                    for i in np.flatnonzero(counts).tolist():
                        t = int(text[i])
                        slots = [f"{read.kind[j]}={read.value(j)}" for j in range(i, i + size) if read.kind[j]] if slotted else []
                        rows.append((int(hashes[i].view(np.int64)), keys[t], copies[t], i - int(read.first[t]), slots))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.string()))], names)

    return df.select(F.col(key).cast("long"), F.xxhash64("text"), "text").mapInArrow(emit, schema)


def _common_words(benchmark: DataFrame) -> np.ndarray:
    """A bitmap of the words that the benchmark has in lower case."""

    def emit(batches):
        for batch in few_at_a_time(batches):
            read = Templates([(t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()], None)
            bits = np.unique(_bit(read.in_lower))
            yield pa.RecordBatch.from_arrays([pa.array(bits // 64), pa.array(np.left_shift(np.int64(1), bits % 64))], ["place", "bits"])

    words = benchmark.select("text").mapInArrow(emit, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(BITS // 64, "<i8")
    for r in words.collect():  # at most BITS / 64 rows
        out[r["place"]] = r["bits"]
    return out.view(np.uint8)


def _short_sizes(benchmark: DataFrame, common: np.ndarray) -> list[int]:
    """Lengths of the items shorter than a window."""

    def emit(batches):
        for batch in few_at_a_time(batches):
            sizes = np.unique(np.diff(Templates([(t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()], common).first))
            yield pa.RecordBatch.from_arrays([pa.array(sizes[(sizes > 0) & (sizes < WINDOW)].astype(np.int64))], ["size"])

    return sorted(r["size"] for r in benchmark.select("text").mapInArrow(emit, "size long").distinct().collect())  # fewer than WINDOW


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 1, prefilter: int = PREFILTER) -> DataFrame:
    """Pairs doc_id, item_id of documents that hold benchmark text, with n_windows and n_slots.

    ``least`` windows must match; of n_windows, n_literal have no slots and n_exact the same values in them. The benchmark's window hashes are sent to
    every task if there are at most ``prefilter`` of them, so that only windows
    that will join are shuffled; beyond that all windows are, with one result.
    """
    common = _common_words(benchmark)
    short = _short_sizes(benchmark, common)
    theirs = persist_table(_windows(benchmark, "item_id", None, common, short, True).select(
        "h", "item_id", F.col("copy").alias("their_copy"), F.col("at").alias("their_at"), F.col("slots").alias("their_slots")).distinct(), "benchmark-windows")
    hashes = theirs.select("h").distinct()
    wanted = None
    if hashes.count() <= prefilter:
        wanted = np.sort(np.array([r["h"] for r in hashes.collect()], np.int64).view(np.uint64))
    ours = _windows(docs, "doc_id", wanted, common, short, False)
    place = ["doc_id", "copy", "item_id", "their_copy", (F.col("at") - F.col("their_at")).alias("shift")]
    window = F.struct("h", "their_slots", (F.col("slots") == F.col("their_slots")).alias("exact"))
    # One row per window of the item at most, so no longer than the item (rows of equal id and text are the same windows again).
    occurrences = ours.join(theirs, "h").groupBy(*place).agg(F.collect_set(window).alias("windows"), F.array_distinct(
        F.flatten(F.collect_set(F.arrays_zip("slots", "their_slots")))).alias("met"))
    torn = F.size("met") > F.size(F.array_distinct("met.their_slots"))
    judged = occurrences.select("doc_id", "item_id", (~torn).alias("whole"), F.explode("windows").alias("w")).groupBy("doc_id", "item_id").agg(
        *(F.size(F.collect_set(F.when(which, F.col("w.h")))).cast("long").alias(name) for name, which in (
            ("n_windows", F.lit(True)), ("n_literal", F.size("w.their_slots") == 0), ("n_exact", F.col("w.exact")), ("counted", F.col("whole") | F.col("w.exact")))),
        F.size(F.array_distinct(F.flatten(F.collect_set("w.their_slots")))).cast("long").alias("n_slots"), F.max("whole").alias("consistent"))
    return judged.where(F.col("counted") >= least).select("doc_id", "item_id", "n_windows", "n_literal", "n_slots", "consistent", "n_exact")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark match, all columns unchanged; a null id is kept."""
    bad = persist_table(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"] == F.col("_bad"), "left_anti")

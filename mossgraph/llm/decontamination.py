"""Benchmark decontamination by templates.

Benchmark items and documents become tokens, in which numbers, names and units are typed placeholders.
Documents' token windows are hash-joined to those of the items. A hit is checked for its slots: along one
alignment the same value of the item must always stand for the same value in the document, and different
names and numbers for different ones; so a question with other numbers or names is caught, and chance is not.

An item of fewer tokens than a window is a window as a whole; items without tokens never match. The items
are broadcast in blocks of bounded size, each against all rows. Null and empty texts match nothing.
Repeated rows return repeated rows; repeated items count once. A document is contaminated by an item if the
checked windows cover at least half of the item's.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 8
COVERED_PERCENT = 50
#: Items in one broadcast, and their characters at most.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16 << 20
#: Distinct words that a worker remembers before it starts anew.
REMEMBERED = 150_000
NUMBER, NAME, UNIT = 1, 2, 3  #: codes of placeholders; words have greater ones, what no item has is 0

#: Units of measure and money.
UNITS = set(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years hz khz mhz ghz w kw mw volt volts amp amps joule joules calorie calories degree degrees celsius fahrenheit kelvin "
    "percent dollar dollars cent cents euro euros yen rupee rupees pesos franc francs kmh mph byte bytes kb mb gb tb".split()
)
_NUMBER = regex.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?")
_EDGE = regex.compile(r"^[^\p{L}\p{N}$€£+-]+|[^\p{L}\p{N}%]+$")
_LETTERS = regex.compile(r"\p{L}+").fullmatch
_END = regex.compile(r"[.!?:;][^\p{L}\p{N}]*$")


class Word(NamedTuple):
    core: str  #: lower case, without punctuation at its edges
    kind: int  #: NUMBER, UNIT, or 0
    capital: bool
    ends: bool  #: whether a sentence ends with it


def classified(raw: str) -> Word:
    core = _EDGE.sub("", raw)
    low = core.lower()
    kind = NUMBER if _NUMBER.fullmatch(core) else UNIT if low in UNITS else 0
    return Word(low, kind, core[:1].isupper() and core[1:].islower(), bool(_END.search(raw)))


def quickly(raw: str) -> Word:
    """``classified``, without patterns for words of letters and at most one mark at the end."""
    core = raw if raw.isalpha() else raw[:-1]
    if not core.isalpha() or not core.isascii() and not _LETTERS(core) or len(core) < len(raw) and raw[-1] not in ",.!?:;":
        return classified(raw)
    low = core.lower()
    return Word(low, UNIT if low in UNITS else 0, core[:1].isupper() and core[1:].islower(), len(core) < len(raw) and raw[-1] != ",")


def tokens(words: list[Word]) -> list[tuple[int, str]]:
    """(placeholder or 0, value) of every word. A capitalised word is a name unless a sentence begins with it."""
    out, begins = [], True
    for w in words:
        if w.core:
            out.append((w.kind or (NAME if w.capital and not begins else 0), w.core))
        begins = w.ends
    return out


class Item(NamedTuple):
    item_id: int
    tokens: list[tuple[int, str]]
    windows: int


#: The code of words without a letter or digit.
_NOTHING = 1 << 62


class _Codes(dict):
    """Raw words that have been met, and their codes."""

    def __init__(self, index: Index):
        super().__init__()
        self.index = index

    def __missing__(self, raw: str) -> int:
        self[raw] = code = self.index.code(raw)
        return code


class Index:
    """The items of one block: codes of their words, and window hash -> (item, offset)."""

    def __init__(self, rows: list[tuple[int, str]], window: int):
        self.window = window
        split = {i: tokens([classified(r) for r in text.split()]) for i, text in rows}
        self.items = [Item(i, t, max(1, len(t) - window + 1)) for i, t in sorted(split.items()) if t]
        self.codes: dict[str, int] = {}
        for item in self.items:
            for kind, value in item.tokens:
                if not kind:
                    self.codes.setdefault(value, len(self.codes) + 4)
        self.windows: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            n = min(window, len(item.tokens))
            own = hashes(np.array([kind or self.codes[value] for kind, value in item.tokens], np.uint64), n)
            for at, h in enumerate(own.tolist()):
                self.windows[n][h].append((k, at))
        self.sorted = {n: np.array(sorted(w), np.uint64) for n, w in self.windows.items()}
        self.marked = {}  #: by the upper 20 bits of a hash, whether a window may have it
        for n, w in self.sorted.items():
            self.marked[n] = np.zeros(1 << 20, bool)
            self.marked[n][(w >> np.uint64(44)).astype(np.int64)] = True
        self.known = _Codes(self)

    def code(self, raw: str) -> int:
        """What a raw word counts as, twice: as a plain word and, in the upper half, as a name. Each is 2 * its code + whether a sentence ends."""
        w = quickly(raw)
        if not w.core:
            return _NOTHING + w.ends
        plain = w.kind or self.codes.get(w.core, 0)
        return (2 * (NAME if w.capital and not w.kind else plain) + w.ends) << 32 | 2 * plain + w.ends

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item's number, its windows found with consistent slots, hits before the check)."""
        raw = text.split()
        if not raw or not self.items:
            return []
        if len(self.known) > REMEMBERED:
            self.known.clear()
        both = np.fromiter(map(self.known.__getitem__, raw), np.int64, len(raw))
        begins = np.append(True, (both[:-1] & 1) == 1)
        codes = np.where(begins, both & 0xFFFFFFFF, both >> 32) >> 1
        codes = codes[both < _NOTHING].astype(np.uint64)
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for n, index in self.sorted.items():
            if len(codes) < n:
                continue
            own = hashes(codes, n)
            maybe = np.flatnonzero(self.marked[n][(own >> np.uint64(44)).astype(np.int64)])
            slot = np.searchsorted(index, own[maybe])
            slot[slot == len(index)] = 0
            for at in maybe[index[slot] == own[maybe]].tolist():
                for k, offset in self.windows[n][int(own[at])]:
                    hits[k, at - offset].append(offset)
        if not hits:
            return []
        own = tokens([classified(w) for w in raw])
        found: dict[int, tuple[set[int], int]] = {}
        for (k, shift), offsets in hits.items():
            item = self.items[k]
            good = consistent(item.tokens, own, shift, offsets, min(self.window, len(item.tokens)))
            old, total = found.get(k, (set(), 0))
            found[k] = (old | good, total + len(offsets))
        return [(k, len(good), total) for k, (good, total) in found.items()]


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n codes in a row; codes that no item has leave no trace by chance alone."""
    mixed = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += mixed[i : i + len(out)]
    return out


def consistent(item: list[tuple[int, str]], doc: list[tuple[int, str]], shift: int, offsets: list[int], n: int) -> set[int]:
    """The offsets whose windows agree word by word and slot by slot with those before along this alignment."""
    there: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    good = set()
    for offset in sorted(offsets):
        new: list[tuple[int, str, str]] = []
        for i in range(offset, offset + n):
            (kind, value), (other, own) = item[i], doc[i + shift]
            if kind != other or (not kind and value != own):
                break
            if kind and (there.get((kind, value), own) != own or (kind != UNIT and back.get((kind, own), value) != value)):
                break
            new.append((kind, value, own))
        else:
            local: dict[tuple[int, str], str] = {}
            if all(local.setdefault((k, v), o) == o for k, v, o in new if k):
                good.add(offset)
                for k, v, o in new:
                    if k:
                        there[k, v], back[k, o] = o, v
    return good


_indexes: dict[str, Index] = {}


def _index(token: str, shared, window: int) -> Index:
    """A block's index, once per worker process, with the words that earlier tasks have met."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = Index(shared.value, window)
    return _indexes[token]


_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("windows", T.LongType()), T.StructField("of", T.LongType())]))
_FOUND_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("windows", pa.int64()), ("of", pa.int64())]))


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of bounded size; the driver holds one at a time."""
    block, chars = [], 0
    for r in benchmark.where(F.col(text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long"), text).distinct().toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, item: str = "item_id", item_text: str = "text", out: str = "leaks") -> DataFrame:
    """``docs`` with the array ``out`` of item_id, its checked windows, and how many it has; a column of that name is replaced."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, _FOUND)])
    at = kept.index(text)
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    made = [rows.withColumn(out, F.array().cast(_FOUND))]
    for block in blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(token, shared, window)
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    part = batch.slice(k, 512)
                    found = [[{"item_id": index.items[i].item_id, "windows": n, "of": index.items[i].windows} for i, n, _ in sorted(index.matches(t or "")) if n] for t in part.column(at).to_pylist()]
                    old = part.column(len(kept)).to_pylist()
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array([a + b for a, b in zip(old, found, strict=True)], _FOUND_ARROW)], [*kept, out])

        made.append(made[-1].mapInArrow(run, schema))
    return made[-1]


def contaminating(leaks: str = "leaks", percent: int = COVERED_PERCENT):
    """The column of items that the checked windows cover far enough."""
    return F.array_sort(F.transform(F.filter(leaks, lambda x: 100 * x["windows"] >= percent * x["of"]), lambda x: x["item_id"]))


def per_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids and n_windows (checked windows of those items) of every row."""
    items = contaminating()
    leaks = matched(docs.select("doc_id", "text"), benchmark)
    total = F.aggregate(F.filter("leaks", lambda x: 100 * x["windows"] >= COVERED_PERCENT * x["of"]), F.lit(0).cast("long"), lambda a, x: a + x["windows"])
    return leaks.select("doc_id", (F.size(items) > 0).alias("contaminated"), items.alias("item_ids"), total.alias("n_windows"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    return matched(rows, benchmark).where(F.size(contaminating()) == 0).select("_row.*")

"""Substring dedup: exact repeats across a corpus are removed, by bytes with suffix arrays or by words with anchors.

Bytes (``byte_repeats``): whatever a 200-byte string covers that also starts anywhere else goes. The shards
that fragments meet in are suffix arrays, made by induced sorting; neighbours with a common prefix of a
window mark the repeats.

Words (``word_repeats``): whatever a window of 50 words covers that also starts in a document of a smaller id
goes. In a shard, the non-overlapping blocks of half a window are indexed by hash and probed by every rolling
window of block size. The hits of a block are extended together, word by word (as 64-bit hashes of words) to both
sides, for as long as any two of them agree; the windows inside such exact repeats go where one of them has a
smaller id. Adjacent windows join to maximal repeats.

All texts are whole and judged as given. Null texts count as empty; texts shorter than a window lose nothing.
Equal texts get equal results, but for words the copies of a larger id lose all. Rows without an id lose no
words and take none from others. An empty table returns no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fragments
from . import words as words_of
from .fragments import NO_ID, Cut
from .suffixes import repeated_starts

WINDOW_BYTES = 200
WINDOW_WORDS = 50
BLOCK_WORDS = WINDOW_WORDS // 2  # each window holds a whole block, wherever it starts
_BYTES = fragments.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def merged(runs: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """The maximal stretches of symbols that runs of windows cover, as (start, end)."""
    out: list[tuple[int, int]] = []
    for at, n in sorted(runs):
        end = at + n - 1 + window
        if out and at <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((at, end))
    return out


def without(symbols, stretches: list[tuple[int, int]]) -> list:
    """The slices of ``symbols`` outside the stretches."""
    edges = [0, *(x for s in stretches for x in s), len(symbols)]
    return [symbols[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


# bytes


def _byte_symbols(text: str) -> np.ndarray:
    return _BYTES[np.frombuffer(text.encode(), np.uint8)]


def _byte_slices(text: str, wanted: list[tuple[int, int]]) -> list[bytes]:
    data = text.encode()
    return [data[a : a + n] for a, n in wanted]


def byte_repeats(docs: DataFrame, window: int = WINDOW_BYTES, gram: int = 32, characters: bool = False, **limits) -> DataFrame:
    """Of every distinct text: h, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that are left; with ``characters`` those of whole characters."""
    known = fragments.texts(docs)
    runs = fragments.repeats(known, Cut(window, gram, _byte_symbols), _byte_slices, lambda content: _BYTES[np.frombuffer(content, np.uint8)], lambda contents, marks: repeated_starts(contents, window), smaller=False, **limits)

    def finish(text: str, found: list[tuple[int, int]]) -> tuple:
        data, gone = text.encode(), merged(found, window)
        parts = without(data, gone)
        kept = b"".join(parts)
        # only the edges of a part can be broken
        left = b"".join(p.decode(errors="ignore").encode() for p in parts) if characters and gone else kept
        return len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), left

    return fragments.covered(known, runs, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", finish)


def bytes_per_document(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    results = byte_repeats(docs).select("h", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return docs.select("doc_id", fragments.hash_of(F.col("text")).alias("h")).join(results, "h").drop("h")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with what is left of each text; characters that a removal has cut apart go too."""
    kept = byte_repeats(docs, characters=True).select("h", F.col("kept").cast("string").alias("kept"))
    rows = docs.withColumn("_row", F.struct(*(F.col(f"`{c}`") for c in docs.columns))).select("_row", fragments.hash_of(F.col("text")).alias("h"))
    return rows.join(kept, "h").select(*(F.col("kept").alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns))


def whole_characters(data: str) -> Column:
    """The text of a column of UTF-8 bytes, without the pieces of broken characters."""
    return F.replace(F.make_valid_utf8(F.col(data).cast("string")), F.lit("\ufffd"), F.lit(""))


# words


def _word_slices(text: str, wanted: list[tuple[int, int]]) -> list[bytes]:
    words = text.encode().split()
    return [b" ".join(words[a : a + n]) for a, n in wanted]


def extended(words: np.ndarray, place: np.ndarray, room: np.ndarray, group: np.ndarray, steps: int, right: bool) -> Iterator[np.ndarray]:
    """Extends the hits of every group word by word to one side: after 0, 1, ... ``steps`` words, the class of each place.

    Places of a class agree in all words so far; -1 where a place agrees with no other, so that its repeat ends there.
    ``room`` is how many words there are on that side. Classes only ever split, and only those that do are sorted."""
    held = group.astype(np.int32)
    yield held
    order = np.argsort(held, kind="stable")
    for d in range(1, steps + 1):
        order = order[room[order] >= d]
        word, last = words[place[order] + d - 1 if right else place[order] - d], held[order]
        new = np.append(True, last[1:] != last[:-1])[: len(order)]
        number = np.cumsum(new) - 1
        differs = word != word[np.flatnonzero(new)[number]]
        if differs.any():
            split = np.zeros(len(order), bool)
            split[number[differs]] = True
            some = np.flatnonzero(split[number])
            by_word = some[np.lexsort((word[some], number[some]))]
            order[some], word[some] = order[by_word], word[by_word]
            new[1:] |= word[1:] != word[:-1]
            number = np.cumsum(new) - 1
        several = np.bincount(number)[number] > 1
        order = order[several]
        held = np.full(len(place), -1, np.int32)
        held[order] = number[several]
        yield held


def anchored(contents: list[bytes], ids: np.ndarray, window: int = WINDOW_WORDS) -> list[np.ndarray]:
    """Of each content, which windows also stand in a content of a smaller id.

    A window holds a whole block of the content it first stands in; all equal windows hit that block at the same offset."""
    block = window // 2
    hashed = [words_of.hashed(c) for c in contents]
    words, size = np.concatenate(hashed), np.array([len(h) for h in hashed])
    start = np.cumsum(size) - size
    own = [fragments.grams(h, block) for h in hashed]
    index = np.unique(np.concatenate([g[::block] for g in own]))
    probes = np.concatenate(own)
    at = np.searchsorted(index, probes)
    at[at == len(index)] = 0
    hit = index[at] == probes
    group = at[hit]
    several = np.bincount(group, minlength=1)[group] > 1
    group = group[several]
    content = np.repeat(np.arange(len(own)), [len(g) for g in own])
    place = (np.arange(len(probes)) + (block - 1) * content)[hit][several]
    content = content[hit][several]
    mark = ids[content]

    flags = np.zeros(len(words), bool)
    after = [*extended(words, place + block, (start + size)[content] - place - block, group, window - block, right=True)]
    for j, before in enumerate(extended(words, place, place - start[content], group, block - 1, right=False)):
        rest = after[window - block - j]
        both = np.flatnonzero((before >= 0) & (rest >= 0))
        both = both[~flags[place[both] - j]]  # what a flagged window would flag, its first occurrence does
        key = before[both].astype(np.int64) * len(place) + rest[both]
        order = np.argsort(key, kind="stable")
        key, both = key[order], both[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        if len(first):
            least = np.repeat(np.minimum.reduceat(mark[both], first), np.diff(np.append(first, len(key))))
            flags[place[both[(least < mark[both]) & (mark[both] != NO_ID)]] - j] = True
    return [flags[s : s + n - window + 1] for s, n in zip(start.tolist(), size.tolist(), strict=True)]


def word_repeats(docs: DataFrame, window: int = WINDOW_WORDS, **limits) -> DataFrame:
    """Of every distinct text, as the row of its least id has it: h, least_id, n_words, n_removed, kept_sha256, whole_sha256 and kept."""
    known = fragments.texts(docs)
    cut = Cut(window, window // 2, lambda text: words_of.hashed(text.encode()))
    runs = fragments.repeats(known, cut, _word_slices, words_of.hashed, lambda contents, marks: anchored(contents, marks, window), smaller=True, **limits)

    def finish(text: str, found: list[tuple[int, int]]) -> tuple:
        words = text.encode().split()
        gone = merged(found, window)
        kept = b" ".join(w for part in without(words, gone) for w in part)
        return len(words), sum(b - a for a, b in gone), hashlib.sha256(kept).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest(), kept

    return fragments.covered(known, runs, "n_words long, n_removed long, kept_sha256 string, whole_sha256 string, kept binary", finish)


def words_per_document(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row. A copy of a text with a smaller id is all repeats, if it has a window."""
    results = word_repeats(docs, window).select("h", "least_id", "n_words", "n_removed", "kept_sha256", "whole_sha256")
    rows = docs.select("doc_id", fragments.hash_of(F.col("text")).alias("h")).join(results, "h")
    copy = (F.col("doc_id") > F.col("least_id")) & (F.col("n_words") >= window)
    none = F.col("doc_id").isNull()
    return rows.select(
        "doc_id",
        "n_words",
        F.when(none, 0).when(copy, F.col("n_words")).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(none, F.col("whole_sha256")).when(copy, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


#: ``words_per_document`` for DuckDB, window by window.
WORDS_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
windows AS (SELECT r, doc_id, p, n, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS l FROM words),
hashed AS (SELECT r, doc_id, p, md5(array_to_string(l, ' ')) AS h FROM windows WHERE p <= n - 49),
first AS (SELECT h, min(doc_id) AS f FROM hashed GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS p FROM hashed JOIN first USING (h) WHERE doc_id > f),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS k, count(*) AS n FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

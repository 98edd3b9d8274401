"""Hashes of words and of word shingles, for many texts at once in numpy.

Words are the runs of anything but ASCII white space. Equal words have equal 64-bit hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .common import WHITE
from .fragments import Powers, grams, mix

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE.encode())] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Bytes hashed at once; longer words are hashed by xxhash, so that the powers stay few.
_BLOCK = 1 << 16
_powers = Powers()


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` start and end."""
    white = np.ones(len(data) + 2, bool)
    white[1:-1] = _IS_WHITE[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of ``data``, and where it starts."""
    start, end = spans(data)
    out = np.zeros(len(start), np.uint64)
    symbols = np.frombuffer(data, np.uint8)
    long = np.flatnonzero(end - start > _BLOCK)
    for i in long.tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    at = 0
    while at < len(start):
        if at < len(start) and end[at] - start[at] > _BLOCK:
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(end, start[at] + _BLOCK, "right")))
        base = int(start[at])
        up, down = _powers.upto(int(end[stop - 1]) - base)
        total = np.zeros(int(end[stop - 1]) - base + 1, np.uint64)
        np.cumsum(_BYTE[symbols[base : end[stop - 1]]] * up, out=total[1:])
        s, e = start[at:stop] - base, end[at:stop] - base
        out[at:stop] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        at = stop
    return mix(out), start


def hashed(data: bytes) -> np.ndarray:
    return hashes(data)[0]


def values(column: pa.Array, rows: int = 256) -> Iterator:
    """The values of a column as Python objects, a few rows at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def chunks(texts: Iterable[str | None], most: int = 1 << 19) -> Iterator[list[str]]:
    """``texts`` (null: empty) in lists of about ``most`` characters."""
    held: list[str] = []
    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the distinct shingles of ``size`` words (A-Z lowered) of all texts, one text after the other, each sorted,
    and how many each text has. A text with fewer words has one shingle of all of them; one without words none."""
    data = [t.encode().lower() for t in texts]
    word, start = hashes(b"\n".join(data))
    bounds = np.searchsorted(start, np.cumsum([0, *(len(d) + 1 for d in data)]))
    n = np.diff(bounds)
    runs = np.maximum(n - size + 1, 0)
    made = grams(word, size) if len(word) >= size else np.zeros(0, np.uint64)
    count = np.where(n == 0, 0, np.maximum(runs, 1))
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    kept = np.zeros(len(out), bool)
    for i, (b, r, c, e) in enumerate(zip(bounds.tolist(), runs.tolist(), count.tolist(), ends.tolist(), strict=False)):
        if r:
            own = np.sort(made[b : b + r])
            out[e - c : e] = own
            kept[e - c] = True
            np.not_equal(own[1:], own[:-1], out=kept[e - c + 1 : e])
        elif c:
            whole = word[b : bounds[i + 1]]
            out[e - 1] = grams(whole, len(whole))[0] ^ np.uint64(len(whole))
            kept[e - 1] = True
    distinct = np.add.reduceat(np.append(kept, False).astype(np.int64), ends - count) if len(ends) else count
    return out[kept], np.where(count == 0, 0, distinct)

"""Suffix arrays by induced sorting, in numpy, and their permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than the next one. The substrings between leftmost S
suffixes (LMS) are sorted by inducing, named by rank, and the string of their names is sorted in turn, by
recursion or, once its alphabet is wide, by doubling ranks. Two linear passes then induce all
suffixes from the sorted LMS ones. A pass goes bucket by bucket, and handles a bucket's entries at once, those
of a run of one symbol included, so that a long run is no more steps than a short one.
"""

from __future__ import annotations

import numpy as np

#: Reduced strings with more symbols than this are sorted by doubling: inducing pays per bucket.
WIDE = 512
#: What is still equal after so many symbols is compared in slices, pair by pair; few texts but periodic ones get there.
SLICED = 1024


def smaller_than_next(s: np.ndarray) -> np.ndarray:
    """S or not, for every suffix; the last symbol is the unique least one."""
    differs = np.append(s[:-1] != s[1:], True)
    less = np.append(s[:-1] < s[1:], True)
    nearest = np.minimum.accumulate(np.where(differs, np.arange(len(s)), len(s))[::-1])[::-1]
    return less[nearest]


def shared_prefix(s: np.ndarray, a: int, b: int, most: int) -> int:
    """How many symbols from ``a`` and from ``b`` on are equal, ``most`` at most."""
    most, done, step = min(most, len(s) - max(a, b)), 0, SLICED
    while done < most:
        n = min(step, most - done)
        differ = s[a + done : a + done + n] != s[b + done : b + done + n]
        if differ.any():
            return done + int(differ.argmax())
        done, step = done + n, 2 * step
    return done


class _Buckets:
    def __init__(self, s: np.ndarray, small: np.ndarray, symbols: int):
        self.s, self.small, self.symbols = s, small, symbols
        at = np.arange(len(s))
        self.ahead = at - np.maximum.accumulate(np.where(np.append(True, s[1:] != s[:-1]), at, 0))  # equal symbols right before
        self.size = np.bincount(s, minlength=symbols)
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.larges = np.bincount(s[~small], minlength=symbols)
        self.present = np.flatnonzero(self.size)

    def _spread(self, places: np.ndarray, before: np.ndarray, edge: np.ndarray, step: int) -> None:
        """Puts suffixes, in order, at the free edge of their symbols' buckets."""
        symbol = self.s[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], before[order]
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        count = np.diff(np.append(first, len(symbol)))
        offset = np.arange(len(symbol)) - np.repeat(first, count)
        places[edge[symbol] + step * offset] = before
        edge[symbol[first]] += step * count

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, if ``lms`` holds the LMS ones in order."""
        s, small = self.s, self.small
        out = np.full(len(s), -1, np.int64)
        symbol = s[lms].astype(np.int64)
        first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
        count = np.diff(np.append(first, len(symbol)))
        lms_of = dict(zip(symbol[first].tolist(), zip(first.tolist(), count.tolist(), strict=True), strict=True))
        edge = self.start.copy()
        for c in self.present.tolist():  # larger suffixes, from the least bucket up
            if edge[c] > (at := int(self.start[c])):
                block = self._with_runs(out[at : edge[c]])
                edge[c] = at + len(block)
                out[at : edge[c]] = block
                self._induce(out, block, c, edge, 1)
            if c in lms_of:
                k, n = lms_of[c]
                self._induce(out, lms[k : k + n], c, edge, 1)
        edge = self.end - 1
        for c in self.present[::-1].tolist():  # smaller suffixes, from the greatest bucket down
            if edge[c] + 1 < (end := int(self.end[c])):
                block = self._with_runs(out[edge[c] + 1 : end][::-1])
                edge[c] = end - 1 - len(block)
                out[edge[c] + 1 : end] = block[::-1]
                self._induce(out, block, c, edge, -1)
            if n := int(self.larges[c]):
                self._induce(out, out[self.start[c] : self.start[c] + n][::-1], c, edge, -1)
        out[0] = len(s) - 1
        return out

    def _with_runs(self, block: np.ndarray) -> np.ndarray:
        """A bucket's suffixes and those of the same symbol right before them: all one symbol away, then all two away, and so on."""
        n = self.ahead[block] + 1
        if len(block) == int(n.sum()):
            return block.copy()
        away = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        order = np.argsort(away, kind="stable")
        return (np.repeat(block, n) - away)[order]

    def _induce(self, out: np.ndarray, block: np.ndarray, symbol: int, edge: np.ndarray, step: int) -> None:
        """Puts what stands before ``block`` into other buckets: larger suffixes upwards, smaller ones downwards."""
        before = block[block > 0] - 1
        before = before[(self.small[before] == (step < 0)) & (self.s[before] != symbol)]
        if len(before):
            self._spread(out, before, edge, step)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; equal substrings share one."""
    end = np.zeros(len(s) + 1, np.int64)
    end[lms] = np.append(lms[1:], lms[-1])
    length = end[ordered] - ordered
    a, b = ordered[:-1], ordered[1:]
    same = length[:-1] == length[1:]
    alive = np.flatnonzero(same)
    for d in range(min(int(length.max()), SLICED) + 1):
        alive = alive[d <= length[alive]]
        if not len(alive):
            break
        differ = s[a[alive] + d] != s[b[alive] + d]
        same[alive[differ]] = False
        alive = alive[~differ]
    for k in alive[length[alive] > SLICED].tolist():
        whole = int(length[k]) + 1
        same[k] = shared_prefix(s, int(a[k]), int(b[k]), whole) == whole
    name = np.zeros(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``names`` in the order of their first ``depth`` symbols at least."""
    rank, k = names, 1
    order = np.argsort(rank, kind="stable")
    while k < depth and rank.max() + 1 < len(rank):
        after = np.zeros(len(rank), np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        held = key[order]
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
        k *= 2
    return order


def suffix_array(s: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """The suffixes of ``s``, whose last symbol is the unique least one, in the order of their first ``depth`` symbols at least."""
    if len(s) < 3:
        return np.argsort(s, kind="stable")[::1]
    small = smaller_than_next(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    buckets = _Buckets(s, small, symbols)
    by_symbol = lms[np.argsort(s[lms], kind="stable")]
    first = buckets.induce(by_symbol)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names = _names(s, lms, ordered)
    distinct = int(names.max()) + 1
    if distinct == len(names):
        return buckets.induce(ordered)
    halved = max(2, -(-depth // 2))  # an LMS substring moves on by two symbols at least
    reduced = suffix_array(names, distinct, halved) if distinct <= WIDE and names[-1] == 0 and (names == 0).sum() == 1 else _doubled(names, halved)
    return buckets.induce(lms[reduced])


def common_prefixes(s: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Of every suffix, in text order, the common prefix with the one before it in order; prefixes beyond ``least`` may be cut to it.

    A suffix whose neighbour follows the neighbour of the suffix before, with an equal symbol ahead of both, has that one's prefix less one; only the others are compared."""
    n = len(s)
    neighbour = np.full(n, -1, np.int64)
    neighbour[order[1:]] = order[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (neighbour[1:] == neighbour[:-1] + 1) & (neighbour[:-1] >= 0) & (s[:-1] == s[neighbour[:-1]])
    compared = np.flatnonzero(~follows & (neighbour >= 0))
    length = np.zeros(n, np.int64)
    alive, a, b = compared, compared, neighbour[compared]
    # a chain is compared at its head, as far as its last member needs
    head = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    need = np.zeros(n, np.int64)
    np.maximum.at(need, head, np.arange(n) - head + least)
    d = 0
    while len(alive) and d < SLICED:
        inside = (a + d < n) & (b + d < n) & (d < need[alive])
        alive, a, b = alive[inside], a[inside], b[inside]
        equal = s[a + d] == s[b + d]
        alive, a, b = alive[equal], a[equal], b[equal]
        length[alive] += 1
        d += 1
    for i, x, y in zip(alive.tolist(), a.tolist(), b.tolist(), strict=True):
        length[i] += shared_prefix(s, x + d, y + d, int(need[i]) - d)
    return np.maximum(length[head] - (np.arange(n) - head), 0)


def repeated_starts(contents: list[bytes], window: int) -> list[np.ndarray]:
    """Of each content (all distinct), which of its windows stand elsewhere in the shard too."""
    parts = []
    for c in contents:
        parts += [np.frombuffer(c, np.uint8).astype(np.int16) + 2, np.ones(1, np.int16)]
    s = np.concatenate([*parts, np.zeros(1, np.int16)])
    order = suffix_array(s, 258, window)
    prefix = common_prefixes(s, order, window)
    in_order = prefix[order]
    shared = in_order >= window
    repeated = np.zeros(len(s), bool)
    repeated[order[shared]] = True
    repeated[order[np.flatnonzero(shared) - 1]] = True
    out, at = [], 0
    for c in contents:
        out.append(repeated[at : at + len(c) - window + 1])
        at += len(c) + 1
    return out

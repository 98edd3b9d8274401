"""Byte-level BPE encoding and decoding by padded numpy matrices.

Every batch's distinct pieces are dealt into matrices by length. In each round every row of a matrix
merges its leftmost pair of least rank; a hash table holds the pairs' ranks, and the matrix is compacted
by one column. Rows without a further pair leave the matrix. A piece wider than the widest shared matrix has a
matrix of its own, whose row merges with the leftmost pair its later equals that don't overlap, so
that it takes as many rounds as it has different pairs merged, not as many as it has bytes.

The ids of all pieces a worker remembers are one flat array; texts gather theirs from it by numpy.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Equal texts give equal ids. An empty
table gives no rows. Other columns stay; one with the output's name is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import chunks, values

#: Pieces up to these lengths share a matrix.
WIDTHS = (4, 8, 16, 32, 64, 128, 256)
#: Distinct pieces that a worker remembers; the first half stays when there are more.
REMEMBERED = 150_000
#: Pieces in one matrix, so that its temporaries stay at a few MB.
ROWS = 16_384
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)


class PairTable:
    """Open addressing: (left id, right id) -> id of the joined token, or ``_NONE``."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        keys = self._key(left, right)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, _NONE, np.int32)
        slot, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] == -1]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.ids[slot[won]] = joined[won]
            rest = np.setdiff1d(rest, won, assume_unique=True)
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._key(left, right)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ids[slot], _NONE)
        rest = np.flatnonzero((there != keys) & (there != -1))
        flat_keys, flat_slot, flat_out = keys.ravel(), slot.ravel().copy(), out.reshape(-1)
        while len(rest):
            flat_slot[rest] = (flat_slot[rest] + 1) & ((1 << self.bits) - 1)
            there = self.keys[flat_slot[rest]]
            hit = there == flat_keys[rest]
            flat_out[rest[hit]] = self.ids[flat_slot[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return flat_out.reshape(keys.shape)


class Codec:
    """The ranks of one vocabulary file and the split pattern that goes with it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        halves = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.pairs = PairTable(*np.array(halves, np.int64).reshape(-1, 3).T)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.known: dict[str, int] = {}
        self.known_ids, self.known_ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each has."""
        counts = np.zeros(len(pieces), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # ids, and the piece of each
        groups: dict[int, list[int]] = {}
        whole, ranks = [], []
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                whole.append(i)
                ranks.append(rank)
            elif len(piece) > WIDTHS[-1]:
                ids = self._row(piece)
                parts.append((ids, np.full(len(ids), i)))
            elif piece:
                groups.setdefault(next(w for w in WIDTHS if len(piece) <= w), []).append(i)
        parts.append((np.array(ranks, np.int32), np.array(whole, np.int64)))
        for width, members in groups.items():
            for k in range(0, len(members), ROWS):
                parts += self._matrix([pieces[i] for i in members[k : k + ROWS]], np.array(members[k : k + ROWS]), width)
        ids, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        counts = np.bincount(of, minlength=len(pieces))
        return ids[np.argsort(of, kind="stable")], counts

    def _matrix(self, pieces: list[bytes], rows: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(p) for p in pieces])
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.bytes[flat], np.int32(-1))
        ranks = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out = []
        while True:
            n = np.arange(len(rows))
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            best = ranks[n, at] if ranks.shape[1] else np.full(len(rows), _NONE)
            if (done := best == _NONE).any():
                there = ids[done] >= 0
                out.append((ids[done][there], np.repeat(rows[done], there.sum(axis=1))))
                ids, ranks, at, best, rows = ids[~done], ranks[~done], at[~done], best[~done], rows[~done]
                n = np.arange(len(rows))
            if not len(rows):
                return out
            ids[n, at] = best
            keep = np.ones(ids.shape, bool)
            keep[n, at + 1] = False
            ids = ids[keep].reshape(len(rows), -1)
            keep = np.ones(ranks.shape, bool)
            keep[n, at] = False
            ranks = ranks[keep].reshape(len(rows), -1)
            for pair in (at - 1, at):  # only the pairs beside the new token change
                k = np.flatnonzero((pair >= 0) & (pair < ranks.shape[1]))
                ranks[k, pair[k]] = self.pairs.find(ids[k, pair[k]], ids[k, pair[k] + 1])

    def _row(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece. Equal pairs merge in one round, unless the first merge makes a pair of a lesser rank."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != _NONE:
            at = np.flatnonzero(ranks == best)
            run = np.maximum.accumulate(np.where(np.append(True, at[1:] != at[:-1] + 1), at, 0))
            at = at[(at - run) % 2 == 0]
            after = self._joined(ids, ranks, at, best)
            if len(at) > 1 and len(after[1]) and after[1].min() < best:
                after = self._joined(ids, ranks, at[:1], best)
            ids, ranks = after
        return ids

    def _joined(self, ids: np.ndarray, ranks: np.ndarray, at: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and ranks after the merges at these places."""
        ids, keep = ids.copy(), np.ones(len(ids), bool)
        ids[at] = token
        keep[at + 1] = False
        ids, keep_ranks = ids[keep], np.ones(len(ranks), bool)
        keep_ranks[at] = False
        ranks = ranks[keep_ranks]
        now = at - np.arange(len(at))
        beside = np.unique(np.concatenate([now - 1, now]))
        beside = beside[(beside >= 0) & (beside < len(ranks))]
        ranks[beside] = self.pairs.find(ids[beside], ids[beside + 1])
        return ids, ranks

    def _learn(self, pieces: list[str]) -> None:
        """Remembers the ids of pieces."""
        known = self.known
        if len(known) > REMEMBERED:
            self.known = known = dict(islice(known.items(), REMEMBERED // 2))
            self.known_ends = self.known_ends[: len(known) + 1].copy()
            self.known_ids = self.known_ids[: self.known_ends[-1]].copy()
        new = [p for p in set(pieces) if p not in known]
        if new:
            ids, counts = self.pieces([p.encode() for p in new])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.known_ids = np.concatenate([self.known_ids, ids])
            self.known_ends = np.concatenate([self.known_ends, self.known_ends[-1] + np.cumsum(counts)])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        split = [self.split(t) for t in texts]
        pieces = list(chain.from_iterable(split))
        self._learn(pieces)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        start, counts = self.known_ends[at], self.known_ends[at + 1] - self.known_ends[at]
        ends = np.append(0, np.cumsum(counts))
        ids = self.known_ids[np.repeat(start - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.cumsum([0, *map(len, split)])])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        ids, counts = self.encode_flat([t or "" for t in texts])
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode_flat(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        parts = []
        for k in range(0, len(ids), 1 << 20):
            part = ids[k : k + (1 << 20)]
            size = self.size[part]
            ends = np.cumsum(size)
            parts.append(self.data[np.repeat(self.start[part] - (ends - size), size) + np.arange(ends[-1])])
        return np.concatenate(parts) if parts else np.zeros(0, np.uint8)

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_flat(np.array(ids, np.int64)).tobytes()


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern)


def _mapped(df: DataFrame, column: str, out: str, kind: T.DataType, each) -> DataFrame:
    """``df`` with the column ``out`` (an earlier one of that name goes), made from ``column``: ``each`` yields an array for the next rows."""
    kept = [c for c in df.columns if c != out]
    at = kept.index(column) if column in kept else None
    if at is None:
        raise ValueError(f"no column {column}")
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            for made in each(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*batch.slice(k, len(made)).columns, made], [*kept, out])
                k += len(made)

    return df.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` and the ids of ``text``, without special tokens; null counts as empty."""

    def each(column: pa.Array) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for texts in chunks(values(column)):
            ids, counts = own.encode_flat(texts)
            yield pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))

    return _mapped(df, text, out, T.ArrayType(T.IntegerType(), False), each)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and the bytes that ``ids`` stand for; null counts as no ids."""

    def each(column: pa.Array) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for k in range(0, len(column), 256):
            part = column.slice(k, 256)
            flat = part.flatten().to_numpy()
            counts = part.value_lengths().fill_null(0).to_numpy()
            size = np.append(0, np.cumsum(own.size[flat]))
            ends = size[np.append(0, np.cumsum(counts))]
            yield pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(own.decode_flat(flat))])

    return _mapped(df, ids, out, T.BinaryType(), each)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    coded = decode(encode(docs.select("doc_id", "text"), path, pattern).drop("text"), path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

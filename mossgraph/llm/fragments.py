"""Which windows of a corpus repeat: texts cut into fragments that meet in shards by content.

A window is a fixed number of consecutive symbols (bytes or words). Its key is the least hash of the k-grams
in it, so equal windows have equal keys wherever they stand. Consecutive windows of one key make a fragment.
Keys that only one fragment has are out; of fragments with equal content one goes on; and those whose key has
several contents meet in that key's shard, where the caller's matcher compares them. A key with more
contents than a shard may hold is taken apart by hashes of its single windows instead. What is found
in a content holds at every place that has it.

Equal texts are collapsed before and counted, so a group of copies costs as much as one text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_dir, written

#: Contents of one key that a shard takes at most.
SHARD_CONTENTS = 8192
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, made as they are asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(_BASE, -1, 1 << 64), k, 1 << 64))])
        return self.up[:n], self.down[:n]


_powers = Powers()


def grams(symbols: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k symbols in a row (64-bit symbol hashes), by doubling."""
    parts, length, have = [], 1, symbols
    while True:
        if k & length:
            parts.append((length, have))
        if length * 2 > k:
            break
        have = have[:-length] * (_STEP + np.uint64(2 * length)) + have[length:]
        length *= 2
    n = len(symbols) - k + 1
    out, at = np.zeros(n, np.uint64), 0
    for length, have in reversed(parts):
        out = out * (_STEP ^ np.uint64(4 * length)) + have[at : at + n]
        at += length
    return mix(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    have, length = values, 1
    while length * 2 <= width:
        have = np.minimum(have[:-length], have[length:])
        length *= 2
    n = len(values) - width + 1
    return np.minimum(have[:n], have[width - length : width - length + n])


@dataclass(frozen=True)
class Cut:
    """How texts become symbols: how many a window and a k-gram have, and their hashes."""

    window: int
    gram: int
    symbols: Callable[[str], np.ndarray]

    def fragments(self, text: str) -> tuple[np.ndarray, ...]:
        """Of each fragment: first window, number of windows, key, a hash of its content, and whether it may repeat within itself."""
        symbols = self.symbols(text)
        if len(symbols) < self.window:
            return *(np.zeros(0, np.int64),) * 4, np.zeros(0, bool)
        g = grams(symbols, self.gram)
        per = self.window - self.gram + 1
        m = least(g, per)
        first = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
        count = np.diff(np.append(first, len(m)))
        up, down = _powers.upto(len(g))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g * up)])
        content = mix((total[first + count + per - 1] - total[first]) * down[first] + count.astype(np.uint64))
        return first, count, m[first].view(np.int64), content.view(np.int64), self._inner(g, m[first], first, first + count + per - 1)

    @staticmethod
    def _inner(g: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which fragments have their key's k-gram twice: only there can two windows be equal."""
        marked = np.zeros(1 << 16, bool)
        marked[(key & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(marked[(g & np.uint64(0xFFFF)).astype(np.int64)])
        keys = np.unique(key)
        rank = np.searchsorted(keys, g[at])
        rank[rank == len(keys)] = 0
        true = keys[rank] == g[at]
        places = np.sort(rank[true] * len(g) + at[true])
        own = np.searchsorted(keys, key) * len(g)
        return np.searchsorted(places, own + end) - np.searchsorted(places, own + start) > 1

    def windows(self, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of every window of a content (symbol hashes)."""
        return grams(content, self.window), grams(mix(content + _STEP), self.window)


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", others: list[str] | None = None) -> DataFrame:
    """The distinct texts (null: empty) as a written table bucketed by ``h``, their hash: h, text, copies, least_id, node (a number).

    With ``others``: also ``row``, those columns of a row of the least id."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(hash_of(F.col(text)).alias("h"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(doc_id).alias("id"), *([F.struct(*(F.col(f"`{c}`") for c in others)).alias("row")] if others else []))
    row = [F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row")] if others else []
    name = f"texts_{uuid.uuid4().hex}"
    rows.groupBy("h").agg(F.first("text").alias("text"), F.count("*").alias("copies"), F.min("id").alias("least_id"), *row).withColumn("node", F.monotonically_increasing_id()).write.option("compression", "zstd").bucketBy(n, "h").option("path", shared_dir(spark)).saveAsTable(name)
    return spark.table(name)


def hash_of(text) -> Column:
    """128 bits of a text's SHA-256."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


_FRAGMENT = {"h": pa.binary(), "mark": pa.int64(), "at": pa.int64(), "n": pa.int32(), "key": pa.int64(), "content": pa.int64()}
_SQL = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int"}


def _cut(known: DataFrame, cut: Cut, mark: str, columns: list[str]) -> DataFrame:
    """These columns of every fragment. Without ``h``, one that may repeat within itself has a second row of another content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                made = [cut.fragments(t) for t in part.column(2).to_pylist()]
                each = pa.array(np.repeat(np.arange(part.num_rows), [len(m[0]) for m in made]))
                first, count, key, content, inner = (np.concatenate(x) for x in zip(*made, strict=True))
                if "h" not in columns and "mark" in columns and inner.any():
                    twice = np.flatnonzero(inner)
                    order = np.concatenate([np.arange(len(key)), twice])
                    content = np.concatenate([content, content[twice] ^ 1])
                    first, count, key, each = first[order], count[order], key[order], each.take(pa.array(order))
                full = {"h": part.column(0), "mark": part.column(1), "at": first, "n": count, "key": key, "content": content}
                yield pa.RecordBatch.from_arrays([full[c].take(each) if c in ("h", "mark") else pa.array(full[c], _FRAGMENT[c]) for c in columns], columns)

    return known.select("h", F.col(mark).cast("long").alias("mark"), "text").mapInArrow(run, ", ".join(f"{c} {_SQL[_FRAGMENT[c]]}" for c in columns))


def _contents(known: DataFrame, wanted: DataFrame, cut: Cut, slices: Callable[[str, list[tuple[int, int]]], list[bytes]]) -> DataFrame:
    """The content of each wanted fragment: h, mark, at, key, content."""
    lists = wanted.groupBy("h").agg(F.collect_list(F.struct("mark", "at", "n", "key")).alias("want"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, text, want = (batch.column(i)[row].as_py() for i in range(3))
                got = slices(text, [(w["at"], w["n"] + cut.window - 1) for w in want])
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(want), pa.binary()), *(pa.array([w[c] for w in want], pa.int64()) for c in ("mark", "at", "key")), pa.array(got, pa.binary())], ["h", "mark", "at", "key", "content"])

    return known.select("h", "text").join(lists, "h").select("h", "text", "want").mapInArrow(run, "h binary, mark long, at long, key long, content binary")


#: Runs of windows and the first window of the fragment that each was found in.
_RUNS = "h binary, start long, at long, n int"
_RUNS_ARROW = pa.schema([("h", pa.binary()), ("start", pa.int64()), ("at", pa.int64()), ("n", pa.int32())])


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - edges[::2]


#: The contents of one or more whole keys and their marks; flags each content's windows.
Matcher = Callable[[list[bytes], np.ndarray], list[np.ndarray]]
#: The mark of texts without an id: greater than all, and never flagged by ``smaller``.
NO_ID = 2**63 - 1


def repeats(known: DataFrame, cut: Cut, slices, symbols_of, match: Matcher, smaller: bool, shard_contents: int = SHARD_CONTENTS, shard_bytes: int = 1 << 20) -> DataFrame:
    """The runs of windows that repeat, by text: h, at, n.

    A window repeats where it stands twice anywhere, copies counted; with ``smaller`` only where it also
    stands in a text of a smaller least_id. Written."""
    spark = known.sparkSession
    if smaller:
        known, mark, total = known.withColumn("mark", F.coalesce(F.col("least_id").cast("long"), F.lit(NO_ID))), "mark", F.count("*")
    else:
        mark, total = "copies", F.sum("mark")
    combined = F.min("mark") if smaller else F.sum("mark")
    with Scratch(spark) as scratch:
        keys = _cut(known, cut, mark, ["key", "content"] if smaller else ["key", "content", "mark"]).groupBy("key").agg(total.alias("total"), F.min("content").alias("low"), F.max("content").alias("high")).where("total > 1 OR low <> high")
        found = scratch.written(_cut(known, cut, mark, [*_FRAGMENT]).join(keys.select("key", (F.col("low") != F.col("high")).alias("several")), "key"))
        same = scratch.written(found.groupBy("key", "content").agg(combined.alias("mark"), F.count("*").alias("times"), F.min(F.struct("mark", "h", "at", "n")).alias("one"), F.first("several").alias("several")))
        if smaller:
            again = found.join(same.where("times > 1").select("key", "content", F.col("mark").alias("first_id"), "one", F.col("several").alias("met")), ["key", "content"]).where(F.col("mark") != NO_ID)
            later, other = F.col("mark") > F.col("first_id"), (F.col("h") != F.col("one.h")) | (F.col("at") != F.col("one.at"))
            of = lambda c: F.when(~later, F.col(f"one.{c}")).alias(c)
            places = scratch.written(again.where(later | (F.col("met") & other)).select(F.col("h").alias("to"), F.col("at").alias("place"), F.col("n").alias("size"), of("h"), of("at")))
            sure = places.where("h IS NULL").select(F.col("to").alias("h"), F.col("place").alias("at"), F.col("size").alias("n"))
        else:
            sure = found.join(same.where("mark > 1").select("key", "content"), ["key", "content"])
        parts = [sure.select("h", "at", "n")]

        several = same.where("several").select("one.h", "one.at", "one.n", "key", "mark")
        wanted = scratch.written(several.join(several.groupBy("key").agg(F.count("*").alias("contents")), "key"))

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0

            def of_held() -> Iterator[pa.RecordBatch]:
                flags = match([x[4] for x in held], np.array([x[1] for x in held]))
                out = [(x[0], x[2], x[2] + a, n) for x, f in zip(held, flags, strict=True) for a, n in zip(*map(np.ndarray.tolist, runs_of(f)), strict=True)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _RUNS_ARROW, strict=True)], schema=_RUNS_ARROW)

            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and size >= shard_bytes and row[3] != held[-1][3]:
                        yield from of_held()
                        held, size = [], 0
                    held.append(row)
                    size += len(row[4])
            if held:
                yield from of_held()

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        matches = [_contents(known, wanted.where(F.col("contents") <= shard_contents), cut, slices).repartition(n, "key").sortWithinPartitions("key").mapInArrow(shards, _RUNS)]
        large = wanted.where(F.col("contents") > shard_contents)
        if large.limit(1).count():
            matches.append(_by_window(_contents(known, large, cut, slices), cut, symbols_of, smaller))
        matched = reduce(DataFrame.unionByName, matches)
        if smaller:
            # other places of the same content and mark have no match of their own
            matched = scratch.written(matched)
            others = places.where("h IS NOT NULL").select("h", F.col("at").alias("start"), "to", "place")
            parts.append(matched.join(others, ["h", "start"]).select(F.col("to").alias("h"), (F.col("place") + F.col("at") - F.col("start")).alias("at"), "n"))
        parts.append(matched.select("h", "at", "n"))
        return written(reduce(DataFrame.unionByName, parts))


def _by_window(contents: DataFrame, cut: Cut, symbols_of, smaller: bool) -> DataFrame:
    """The same for keys with too many contents, window by window: equal windows have equal hashes (128 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                h, mark, start, content = (batch.column(i)[row].as_py() for i in (0, 1, 2, 4))
                one, two = cut.windows(symbols_of(content))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(one), pa.binary()), pa.array(np.full(len(one), start)), pa.array(np.arange(start, start + len(one))), pa.array(np.full(len(one), mark)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["h", "start", "at", "mark", "one", "two"])

    rows = contents.mapInArrow(run, "h binary, start long, at long, mark long, one long, two long")
    groups = rows.groupBy("one", "two").agg(F.count("*").alias("times"), F.sum(F.when(F.lit(not smaller), F.col("mark"))).alias("copies"), F.min("mark").alias("first_id"))
    hit = rows.join(groups.where("times > 1" if smaller else "copies > 1"), ["one", "two"])
    if smaller:
        hit = hit.where((F.col("mark") > F.col("first_id")) & (F.col("mark") != NO_ID))
    return hit.select("h", "start", "at", F.lit(1).alias("n"))


def covered(known: DataFrame, runs: DataFrame, schema: str, finish: Callable[[str, list[tuple[int, int]]], tuple]) -> DataFrame:
    """``finish`` of every distinct text and its runs: h, copies, least_id and the columns of ``schema``."""
    lists = runs.groupBy("h").agg(F.collect_list(F.struct("at", "n")).alias("runs"))
    rows = known.join(lists, "h", "left").select("h", "copies", "least_id", "text", "runs")
    full = "h binary, copies long, least_id long, " + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                made = [finish(t, [(r["at"], r["n"]) for r in rs or []]) for t, rs in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(pa.int64()), *map(pa.array, zip(*made, strict=True))], names)

    names = [c.strip().split(" ")[0] for c in full.split(",")]
    return rows.mapInArrow(run, full)

"""N-gram Jaccard join by parity sketches: components of documents whose shingle sets are alike enough.

A set is dealt by hash into segments, and every shingle flips one of 2^20 bits of its segment. Two sketches
differ in no more bits than the sets have unshared shingles, and a link of sizes a and b leaves at most
D = (a + b) * (100 - p) / (100 + p) of those. Sketches are made per size band, with D + 1 segments for the
band's largest D: of these, one at least has no unshared shingle, and segments are joined by it (pigeonhole).

* That one may have no shingle at all, and then it says nothing. In bands of many segments it would have to be
  so with each of a third of the segments: ``missed`` bounds the chance, and from 2^-64 on, that of two shingles
  with one hash, nothing is done about it. In bands below, a set has its empty segments only beside a few
  following segments with one bit left out or none: if only empty segments are equal, of 2e - 1 others after one
  of e such, one differs by a bit exactly (else there were more than D differences).
* Bands of small sets have D / 2 + 1 segments, one of which differs by a bit at most, with the same variants.

Sharers of a segment are tested against one of them, exactly, and what links is one component; sharers outside it
get a new one to be tested against, twice. It is the one that shares most segments: of near copies, that which has
changed least. Members of one segment that are still in several components
are then compared with each other, in blocks of bounded size: first plain parity sketches, whose Hamming distance
is never more than the difference, by bit operations on whole blocks; only pairs near enough become rows and are
tested exactly. So groups of copies cost a few tests for each copy, documents that merely share a passage cost
no row, and no link between different texts is lost.

Null texts count as empty. Documents without words have size 0 and component of their own. Equal texts link
if they have words. Rows without an id take part, and do not count in a component's least id. An empty table
gives no rows. Columns other than ``doc_id`` and ``text`` are not looked at by ``per_document``.
"""

from __future__ import annotations

import bisect
import math
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fragments, words
from .common import Scratch, fewer, written
from .components import components
from .fragments import mix

SHINGLE = 4
PERCENT = 85
BAND_RATIO = 1.3
#: Bands up to this size use variants instead of more segments.
SMALL = 96
#: Binary logarithm of the chance of a missed pair that is as good as none.
NEVER = -64.0
#: New hubs for the sharers of a segment that are outside the component of the one before.
HUBS = 2
#: Members of one segment that a task compares with each other, and 64-bit words of their sketches that it looks at.
BLOCK, BLOCK_WORDS = 1024, 1024
_BIT = np.uint64(44)
_SEED = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the distinct shingles; with fewer words than one, of the whole sequence."""
    return words.shingle_sets([text], size)[0]


@lru_cache(maxsize=8)
def band_edges(ratio: float = BAND_RATIO) -> list[int]:
    """The least size of every band."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return edges


def bands(n: int, percent: int) -> list[int]:
    """The bands of a set's own size and of all sizes above that it may link with."""
    edges = band_edges()
    own = bisect.bisect_right(edges, n) - 1
    return list(range(own, bisect.bisect_right(edges, 100 * n // percent)))


def most_differences(band: int, percent: int) -> int:
    return 2 * (band_edges()[band + 1] - 1) * (100 - percent) // (100 + percent)


def missed(segments: int, unshared: int, shared: int) -> float:
    """Binary logarithm of the chance that every segment without an unshared shingle has no shared one either, dealt at random."""
    occupied = np.zeros(segments + 1)  # chance of so many segments with unshared shingles
    occupied[0] = 1
    k = np.arange(segments + 1)
    for _ in range(unshared):
        now = occupied * k / segments
        now[1:] += occupied[:-1] * (segments - k[:-1]) / segments
        occupied = now
    return math.log2(max(float((occupied * (k / segments) ** shared).sum()), 1e-300))


@lru_cache(maxsize=4096)
def empties_count(band: int, percent: int) -> bool:
    """Whether empty segments of this band need keys of their own. The sets of a pair in it have at least the sizes of the band below."""
    d = most_differences(band, percent)
    if d > 1000:
        return percent < 10
    largest, least = 2 * (band_edges()[band + 1] - 1), band_edges()[band] * (100 + percent) // 100
    return any(missed(d + 1, u, (size - u) // 2) > NEVER for size in (largest, (largest + least) // 2, least) for u in [min(d, size * (100 - percent) // (100 + percent))])


def _beside_empties(flip: np.ndarray, segment: np.ndarray, found: np.ndarray, tag: np.ndarray) -> list[np.ndarray]:
    """The keys of the empty segments of one set."""
    m = len(found)
    empty = np.flatnonzero(np.bincount(segment, minlength=m) == 0)
    out = []
    for i in empty.tolist():
        for step in range(1, min(m - 1, 2 * len(empty) - 1) + 1):
            j = (i + step) % m
            variants = np.append(found[j], found[j] ^ flip[segment == j])
            out.append(mix(mix(variants ^ tag[j]) ^ tag[i]))
    return out


def keys_of(tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The pigeonhole keys of sets given one after the other, each with the number of its set: two sets that link share one."""
    of = [bands(n, percent) if n else [] for n in counts.tolist()]
    bits = mix(tokens ^ _SEED)
    flips = mix((mix(bits) >> _BIT) + _SEED)
    ends = np.cumsum(counts)
    made, owner = [], []
    for k in range(max(map(len, of), default=0)):
        sets = np.array([i for i, b in enumerate(of) if len(b) > k])
        band = np.array([of[i][k] for i in sets])
        d = np.array([most_differences(b, percent) for b in band.tolist()])
        small = np.array([band_edges()[b + 1] <= SMALL for b in band.tolist()])
        m = np.where(small, d // 2 + 1, d + 1)
        base = np.cumsum(m) - m
        n = counts[sets]
        at = np.arange(int(n.sum())) + np.repeat((ends - counts)[sets] - (np.cumsum(n) - n), n)
        which = np.repeat(np.arange(len(sets)), n)
        flip = np.where(d[which] == 0, bits[at], flips[at])
        segment = ((bits[at] >> np.uint64(32)) * m[which].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[which]
        found = np.zeros(int(m.sum()), np.uint64)
        np.bitwise_xor.at(found, segment, flip)
        set_of = np.repeat(np.arange(len(sets)), m)
        tag = mix((band[set_of].astype(np.uint64) << np.uint64(40)) | (np.arange(len(found)) - base[set_of]).astype(np.uint64))
        full = small[set_of] | (np.bincount(segment, minlength=len(found)) > 0)
        made.append(mix(found[full] ^ tag[full]))
        owner.append(sets[set_of[full]])
        varied = small[which] & (d[which] > 0)
        made.append(mix(found[segment[varied]] ^ flip[varied] ^ tag[segment[varied]]))
        owner.append(sets[which[varied]])
        for i in np.flatnonzero(~small & (np.bincount(set_of[full], minlength=len(sets)) < m)).tolist():
            if empties_count(int(band[i]), percent):
                own, part = which == i, slice(int(base[i]), int(base[i] + m[i]))
                more = _beside_empties(flip[own], segment[own] - base[i], found[part], tag[part])
                made += more
                owner += [np.full(len(x), sets[i]) for x in more]
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(made), np.concatenate(owner)


def keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The pigeonhole keys of one set."""
    return np.unique(keys_of(tokens, np.array([len(tokens)]), percent)[0])


def sketch_words(n: int) -> int:
    """64-bit words of a sketch with at least four bits for each of n shingles; a power of two."""
    return 1 << max(0, int(4 * n - 1).bit_length() - 6) if n > 16 else 1


def sketches_of(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The parity of every set's hashes over ``sketch_words``."""
    size = np.array([sketch_words(n) for n in counts.tolist()], np.int64)
    base = np.cumsum(size) - size
    hashed = mix(tokens + _SEED)
    of = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(int(size.sum()), np.uint64)
    np.bitwise_xor.at(out, ((hashed >> np.uint64(6)) & (size[of] - 1).astype(np.uint64)).astype(np.int64) + base[of], np.uint64(1) << (hashed & np.uint64(63)))
    return [out[b : b + n].tobytes() for b, n in zip(base.tolist(), size.tolist(), strict=True)]


def sketch(tokens: np.ndarray) -> bytes:
    """The parity sketch of one set."""
    return sketches_of(tokens, np.array([len(tokens)]))[0]


def folded(sketch: bytes | np.ndarray, size: int) -> np.ndarray:
    """A sketch at ``size`` 64-bit words, no more than it has."""
    x = np.frombuffer(sketch, np.uint64) if isinstance(sketch, bytes) else sketch
    return np.bitwise_xor.reduce(x.reshape(-1, size), axis=0)


def hamming(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the length of the other; the sets differ in as many elements or more."""
    size = min(len(a), len(b)) // 8
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def near_pairs(nodes: np.ndarray, of: np.ndarray, side: np.ndarray, counts: np.ndarray, drawn: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of nodes of different components (``of``) that their sketches don't rule out, least first; of two sides only those across."""
    size = min(BLOCK_WORDS, min(len(x) for x in drawn) // 8)
    matrix = np.stack([folded(x, size) for x in drawn])
    two = side.min() != side.max()
    a, b = [], []
    for i in range(len(nodes) - 1):
        j = np.arange(i + 1, len(nodes))
        j = j[(of[j] != of[i]) & (100 * np.minimum(counts[j], counts[i]) >= percent * np.maximum(counts[j], counts[i])) & (~two | (side[j] != side[i]))]
        if len(j):
            j = j[(100 + percent) * np.bitwise_count(matrix[j] ^ matrix[i]).sum(axis=1, dtype=np.int64) <= (counts[j] + counts[i]) * (100 - percent)]
            a.append(np.full(len(j), nodes[i]))
            b.append(nodes[j])
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    return np.minimum(x, y), np.maximum(x, y)


def drawn_sets(known: DataFrame, size: int = SHINGLE) -> DataFrame:
    """node, h, n_shingles and sketch of every text of ``fragments.texts``; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in words.chunks(words.values(batch.column(2))):
                tokens, counts = words.shingle_sets(texts, size)
                part = batch.slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(sketches_of(tokens, counts), pa.binary())], ["node", "h", "n_shingles", "sketch"])

    return written(known.select("node", "h", "text").mapInArrow(run, "node long, h binary, n_shingles long, sketch binary"))


def _sharers(scratch: Scratch, known: DataFrame, percent: int, size: int) -> DataFrame:
    """Who shares a key: key, node and degree (how many keys the node shares), for each key of several nodes; written.

    Keys that several texts of about a million keys have leave as one row, so a key of very many texts is few rows.
    The keys themselves are not written: that costs shingling twice, and the larger part of the disk less."""

    def combined(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((node, key)) if (node[1:] < node[:-1]).any() else np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
        key, node = key[new], node[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(first, len(key))) - 1
        more = np.ones(len(key), bool)
        more[first] = False
        others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32(), mask=np.append(count == 0, False)), pa.array(node[more], pa.int64()))
        for k in range(0, len(first), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(key[first[k : k + 50_000]]), pa.array(node[first[k : k + 50_000]]), others.slice(k, 50_000)], ["key", "node", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            nodes, at = batch.column(0).to_numpy(), 0
            for texts in words.chunks(words.values(batch.column(1))):
                key, owner = keys_of(*words.shingle_sets(texts, size), percent)
                order = np.argsort(owner, kind="stable")
                held.append((key[order].view(np.int64), nodes[at + owner[order]]))
                at += len(texts)
                if sum(len(k) for k, _ in held) > 1_000_000:
                    yield from combined(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
        if held:
            yield from combined(*map(np.concatenate, zip(*held, strict=True)))

    rows = known.select("node", "text").mapInArrow(run, "key long, node long, others array<long>")
    of = Window.partitionBy("key")
    shared = rows.withColumn("n", F.count("*").over(of)).where("n > 1 OR others IS NOT NULL")
    members = scratch.written(shared.select("key", F.concat(F.array("node"), F.coalesce("others", F.array().cast("array<long>"))).alias("members")))
    each = members.select("key", F.explode("members").alias("node"))
    return scratch.written(fewer(each.join(each.groupBy("node").agg(F.count("*").alias("degree")), "node")))


def _spokes(sharers: DataFrame) -> DataFrame:
    """key, node, hub and hub_degree for each sharer but the hub of a key, which has the greatest degree (of equal ones the least node)."""
    top = sharers.groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("less"))).alias("top"))
    return sharers.join(top, "key").select("key", "node", "degree", (-F.col("top.less")).alias("hub"), F.col("top.degree").alias("hub_degree")).where("node <> hub")


def _tested(scratch: Scratch, known: DataFrame, drawn: DataFrame, pairs: DataFrame, percent: int, size: int) -> DataFrame:
    """The written pairs (a, b) that link: by their sketches where those differ too much, or else by the sets; written."""
    side = lambda s: drawn.select(F.col("node").alias(s), *(F.col(c).alias(c[0] + s) for c in ("h", "n_shingles", "sketch")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = (batch.column(4).to_numpy() + batch.column(5).to_numpy()) * (100 - percent) // (100 + percent)
            kept = [hamming(batch.column(6)[i].as_py(), batch.column(7)[i].as_py()) <= d for i, d in enumerate(sizes.tolist())]
            yield batch.select(["a", "b", "ha", "hb"]).filter(pa.array(kept, pa.bool_()))

    close = scratch.written(fewer(both.select("a", "b", "ha", "hb", "na", "nb", "sa", "sb")).mapInArrow(near, "a long, b long, ha binary, hb binary"))
    texts = known.select("h", "text")
    one = close.join(texts.withColumnsRenamed({"h": "hb", "text": "tb"}), "hb").drop("hb")
    whole = one.join(texts.withColumnsRenamed({"h": "ha", "text": "ta"}), "ha").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, np.ndarray] = OrderedDict()

        def tokens(node: int, text: pa.StringScalar) -> np.ndarray:
            if node not in held:
                held[node] = shingles(text.as_py(), size)
                if len(held) > 64:
                    held.popitem(last=False)
            return held[node]

        for batch in batches:
            linked = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:], strict=True):
                x, y = tokens(a, ta), tokens(b, tb)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return scratch.written(fewer(whole.mapInArrow(run, "a long, b long, linked boolean").where("linked").select("a", "b")))


def _labelled(rows: DataFrame, found: DataFrame, node: str, name: str) -> DataFrame:
    """``rows`` with the component of the column ``node``, by default the node itself."""
    return rows.join(found.select(F.col("node").alias(node), F.col("component").alias("_c")), node, "left").withColumn(name, F.coalesce("_c", node)).drop("_c")


def _block_pairs(members: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """a and b: members (key, node, c) of one key and of different components whose sketches are near enough.

    Keys with the same members are looked at once. The members of a key are dealt into blocks, and each two blocks meet in one group."""
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = members.groupBy("key").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("two"))
    once = every.where("low <> high").groupBy("n", "one", "two").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(once, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "c").join(drawn.select("node", "n_shingles", "sketch"), "node")
    rows = rows.select("key", "low", "high", "own", "node", "c", "n_shingles", "sketch").repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def of_held() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            if whole.num_rows > 1:
                own, node, c, count = (whole.column(k).to_numpy() for k in range(3, 7))
                a, b = near_pairs(node, c, own, count, whole.column(7).to_pylist(), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy() for k in range(3)])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for p, q in zip(edges, edges[1:]):  # noqa: B905, RUF007
                if p == q:
                    continue
                now = tuple(key[:, p].tolist())
                if held and now != group:
                    yield from of_held()
                    held = []
                group = now
                held.append(batch.slice(p, q - p))
        if held:
            yield from of_held()

    return rows.mapInArrow(run, "a long, b long").distinct()


def linked_components(known: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """node and component of every text of ``fragments.texts`` that links with another, and node, h, n_shingles and sketch of all; written."""
    with Scratch(known.sparkSession) as scratch:
        drawn = drawn_sets(known, size)
        sharers = _sharers(scratch, known, percent, size)
        ordered = [F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")]
        first = _spokes(sharers).groupBy("node").agg((-F.max(F.struct("hub_degree", (-F.col("hub")).alias("less")))["less"]).alias("hub"))
        tested = scratch.written(fewer(first.select(*ordered).distinct()))
        found = components(_tested(scratch, known, drawn, tested, percent, size))

        def more(pairs: DataFrame) -> bool:
            """Tests pairs that were not tested yet; whether some link."""
            nonlocal tested, found
            new = scratch.written(fewer(pairs.join(tested, ["a", "b"], "left_anti")))
            if new.isEmpty():
                return False
            linked = _tested(scratch, known, drawn, new, percent, size)
            tested = tested.unionByName(new)
            if linked.isEmpty():
                return False
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(linked))
            return True

        now = sharers
        for k in range(1 + HUBS):
            spokes = _labelled(_labelled(_spokes(now), found, "node", "cn"), found, "hub", "ch").where("cn <> ch")
            now = scratch.written(fewer(spokes.select("key", "node", "degree", "hub")))
            if not more(now.select(*ordered).distinct()) and k:
                break
        more(_block_pairs(scratch.written(_labelled(sharers.select("key", "node"), found, "node", "c")), drawn, percent))
        return found, drawn


def one_of_each(docs: DataFrame, percent: int, size: int) -> DataFrame:
    """``docs`` with one row of every component, one of its least id. Texts without words, which link with nothing, all stay."""
    worded = F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    known = fragments.texts(docs.where(worded), others=[c for c in docs.columns if c != "text"])
    found, _ = linked_components(known, percent, size)
    nodes = known.select("node", "least_id").join(found, "node")
    kept = nodes.groupBy("component").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "node")).alias("best")).select(F.col("best.node").alias("node"))
    gone = written(nodes.join(kept, "node", "left_anti").join(known.select("node", "h"), "node").select("h"))
    rest = known.select("h", "text", "row").join(gone, "h", "left_anti").select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
    return rest.unionByName(docs.where(~worded))


def per_document(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    known = fragments.texts(docs)
    found, drawn = linked_components(known, percent, size)
    nodes = written(known.select("h", "node", "least_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = nodes.groupBy("component").agg(F.min("least_id").alias("component_id"))
    results = drawn.select("h", "n_shingles").join(nodes.join(least, "component").select("h", "component_id"), "h")
    return docs.select("doc_id", fragments.hash_of(F.col("text")).alias("h")).join(results, "h").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: ``per_document`` for DuckDB: all pairs that share a shingle, and what is reached by links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n FROM d),
runs AS (SELECT r, p, n, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l FROM words),
s AS (SELECT DISTINCT r, array_to_string(l, ' ') AS t FROM runs WHERE p <= n - 3 OR (n < 4 AND p = 1)),
c AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pair AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM s AS a JOIN s AS b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN c AS x ON x.r = a JOIN c AS y ON y.r = b WHERE 100 * pair.n >= 85 * (x.n + y.n - pair.n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b)
SELECT d.doc_id, coalesce(any_value(c.n), 0) AS n_shingles, min(o.doc_id) AS component_id FROM d JOIN reach ON reach.a = d.r JOIN d AS o ON o.r = reach.b LEFT JOIN c ON c.r = d.r GROUP BY d.r, d.doc_id"""

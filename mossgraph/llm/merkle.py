"""A Merkle manifest of a table: one tree per key (lang), its leaves in order, and a tree over the keys' roots.

A leaf is the SHA-256 of a row's fields, each ``-`` if null and else its UTF-8 length, a colon and its value. Every
``FAN`` consecutive nodes become the hash of their hex digests, until one is left. A parent retains, for each child
slot, a copy of its hash state from before that child. To fold a changed leaf the state of its slot is resumed with
the new digest and the siblings to the right; those to the left are never hashed again.

Rows are dealt out by ranges of (key, order), counted within each range, and so numbered without a sort in one task.
The tree is cut into blocks of ``FAN ** deep`` nodes. Going up, each block is reduced to its root in a task; going
down, each block gets the siblings on the way from its root to the top as one row, and folds its own nodes. No task
holds more than a block, hash states never leave the task that made them, and the driver sees only the root.

Rows of a null key are a tree of their own, which comes first. Rows of one key come by order, null first, then by
leaf; repeated rows are leaves of their own. A null text is a field of its own kind and differs from an empty one.
An empty table has no rows and no root. Rows without an order value are never taken as changed by ``lowered``.
Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, written

FAN = 8
#: Levels of a block, which has ``FAN`` to that power nodes at most.
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_PATH = "array<struct<slot:int,siblings:array<string>>>"


def leaf(fields: Sequence[Column]) -> Column:
    """The leaf of a row."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)).cast("binary"), 256)


class Parent:
    """A node over its children's digests, with the hash state before each of them."""

    def __init__(self, children: Sequence[str]):
        self.children, self.states = list(children), []
        state = hashlib.sha256()
        for child in self.children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        """Its digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(replacement.encode())
        state.update("".join(self.children[slot + 1 :]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> list[str]:
        return self.children[:slot] + self.children[slot + 1 :]


def levels(nodes: list[str], whole: bool, deep: int) -> list[list[Parent]]:
    """The parents above ``nodes``, level by level: up to one node if they are a ``whole`` tree, else ``deep`` levels."""
    made: list[list[Parent]] = []
    while len(nodes) > 1 if whole else len(made) < deep:
        made.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
        nodes = [p.digest for p in made[-1]]
    return made


def root_of(nodes: list[str], whole: bool, deep: int) -> str:
    made = levels(nodes, whole, deep)
    return made[-1][0].digest if made else nodes[0]


def path_of(made: list[list[Parent]], at: int) -> list[dict]:
    """Slot and siblings of node ``at`` and of its parents below the top."""
    out = []
    for level in made:
        out.append({"slot": at % FAN, "siblings": level[at // FAN].siblings(at % FAN)})
        at //= FAN
    return out


def resumed(path: list[dict]) -> list[tuple[object, bytes]]:
    """Of each parent on a path from a block to the top: its state before the slot on the path, and what follows the slot."""
    out = []
    for step in path:
        parent = Parent([*step["siblings"][: step["slot"]], "", *step["siblings"][step["slot"] :]])
        out.append((parent.states[step["slot"]], "".join(parent.children[step["slot"] + 1 :]).encode()))
    return out


# numbers and blocks


def ranked(scratch: Scratch, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` (written) with n, the number of rows of its ``key`` (not null), and pos, its place among those by ``order``.

    Equal rows are told apart by where they are read, so that any number of them is dealt over tasks."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(parts, key, *order, "_id").sortWithinPartitions(key, *order, "_id").drop("_id").withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema, T.StructField("_at", T.LongType())])
    column = dealt.columns.index(key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            at = []
            for k in batch.column(column).to_pylist():
                n = n + 1 if k == last else 0
                last = k
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], schema.fieldNames())

    counted = scratch.written(dealt.mapInArrow(count, schema))
    sizes = counted.groupBy(key, "_part").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(key)  # a row per range at most
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(key, "_part", before.alias("_before"), F.sum("_c").over(whole).alias("n"))
    return counted.join(offsets, [key, "_part"]).withColumn("pos", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def _blocked(nodes: DataFrame, deep: int, paths: DataFrame | None = None) -> DataFrame:
    """Nodes by blocks, in order; before those of a block comes the row with its path, if ``paths`` are given."""
    rows = nodes.withColumn("block", F.floor(F.col("pos") / FAN**deep))
    if paths is not None:
        rows = rows.unionByName(paths.select("grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path", "subroot"), allowMissingColumns=True)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one block after the other."""
    rows = (row for batch in batches for at in range(0, batch.num_rows, 512) for row in batch.slice(at, 512).to_pylist())
    for _, block in groupby(rows, itemgetter("grp", "block")):
        yield list(block)


def _whole(block: list[dict], deep: int) -> bool:
    return block[-1]["n"] <= FAN**deep


def above(nodes: DataFrame, deep: int) -> DataFrame:
    """The roots of the blocks of ``nodes`` (grp, n, pos, digest), as the nodes of a smaller tree."""
    schema = "grp string, n long, pos long, digest string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [{"grp": b[0]["grp"], "n": -(-b[0]["n"] // FAN**deep), "pos": b[0]["block"], "digest": root_of([r["digest"] for r in b], _whole(b, deep), deep)} for b in _blocks(batches)]
        yield pa.RecordBatch.from_pylist(made, pa.schema([("grp", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.string())]))

    return _blocked(nodes.select("grp", "n", "pos", "digest"), deep).mapInArrow(run, schema)


def _paths(nodes: DataFrame, paths: DataFrame, deep: int) -> DataFrame:
    """grp, pos, path and subroot of all ``nodes``, from those of their blocks."""
    schema = f"grp string, pos long, path {_PATH}, subroot string"
    arrow = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.struct([("slot", pa.int32()), ("siblings", pa.list_(pa.string()))]))), ("subroot", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _blocks(batches):
            made = levels([r["digest"] for r in rows], _whole(rows, deep), deep)
            yield pa.RecordBatch.from_pylist([{"grp": r["grp"], "pos": r["pos"], "path": [*path_of(made, i), *head["path"]], "subroot": head["subroot"]} for i, r in enumerate(rows)], arrow)

    return _blocked(nodes.select("grp", "n", "pos", "digest"), deep, paths).mapInArrow(run, schema)


# manifests


@dataclass(frozen=True)
class Manifest:
    """tiers: the nodes of the trees of all keys (grp, n, pos, digest), leaves first, each tier the block roots of the one before; keys: likewise above the keys' roots."""

    tiers: list[DataFrame]
    keys: list[DataFrame]
    root: str | None
    deep: int

    def block_paths(self, scratch: Scratch) -> DataFrame:
        """grp, pos, path and subroot of the blocks of leaves."""
        spark = self.tiers[0].sparkSession
        paths = spark.range(1).select(F.lit("").alias("grp"), F.lit(0).cast("long").alias("pos"), F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
        for nodes in reversed(self.keys[:-1]):
            paths = scratch.written(_paths(nodes, paths, self.deep))
        # the nodes of the keys' tree are the tops of the trees of the keys
        tops = self.keys[0].select(F.col("of").alias("grp"), F.col("pos").alias("_pos"), F.col("digest").alias("subroot"))
        paths = scratch.written(paths.select(F.col("pos").alias("_pos"), "path").join(tops, "_pos").select("grp", F.lit(0).cast("long").alias("pos"), "path", "subroot"))
        for nodes in reversed(self.tiers[1:-1]):
            paths = scratch.written(_paths(nodes, paths, self.deep))
        return paths


def _grown(scratch: Scratch, nodes: DataFrame, deep: int) -> list[DataFrame]:
    """``nodes`` and the tiers above, up to one node of each group."""
    tiers = [nodes]
    while True:
        tiers.append(scratch.written(above(tiers[-1], deep)))
        if tiers[-1].where("n > 1").isEmpty():
            return tiers


def build(scratch: Scratch, leaves: DataFrame, key: str = "key", order: str = "at", deep: int = LEVELS) -> Manifest:
    """The manifest of ``leaves`` (key, at, digest and others, written), which stay in its first tier; its tables are in ``scratch``."""
    marked = leaves.withColumn("grp", F.coalesce(F.concat(F.lit("="), F.col(key)), F.lit("")))  # keeps the order of keys, null first
    tiers = _grown(scratch, scratch.written(ranked(scratch, marked, "grp", [order, "digest"])), deep)
    tops = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    keys = _grown(scratch, scratch.written(ranked(scratch, tops, "grp", ["of"])), deep)
    top = keys[-1].first()
    return Manifest(tiers, keys, top and top["digest"], deep)


def folded(scratch: Scratch, made: Manifest, proofs: bool = False) -> DataFrame:
    """Every leaf (at, digest and changed, a digest or null) with subroot, root, proof_sha256, the folded root and whether that is the root.

    With ``proofs`` also the proof itself: slot and siblings of every level, leaf to top."""
    at = made.tiers[0].schema["at"].dataType
    schema = T.StructType([T.StructField("at", at), *(T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), T.StructField("verified", T.BooleanType())])
    if proofs:
        schema.add("proof", T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("siblings", T.ArrayType(T.StringType()))])))
    arrow, root, deep = to_arrow_schema(schema), made.root, made.deep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _blocks(batches):
            tree = levels([r["digest"] for r in rows], _whole(rows, deep), deep)
            upper, rest = resumed(head["path"]), "".join(s for step in head["path"] for s in step["siblings"]).encode()
            out = []
            for i, r in enumerate(rows):
                now, proof, k = r["changed"] or r["digest"], hashlib.sha256(), i
                for level in tree:
                    parent, slot = level[k // FAN], k % FAN
                    proof.update("".join(parent.siblings(slot)).encode())
                    now = parent.folded(slot, now)
                    k //= FAN
                proof.update(rest)
                for state, right in upper:
                    state = state.copy()
                    state.update(now.encode())
                    state.update(right)
                    now = state.hexdigest()
                out.append({"at": r["at"], "leaf": r["digest"], "subroot": head["subroot"], "root": root, "proof_sha256": proof.hexdigest(), "folded_root": now, "verified": now == root})
                if proofs:
                    out[-1]["proof"] = [*path_of(tree, i), *head["path"]]
            yield pa.RecordBatch.from_pylist(out, arrow)

    if made.root is None:
        return made.tiers[0].sparkSession.createDataFrame([], schema)
    return _blocked(made.tiers[0].select("grp", "n", "pos", "digest", "at", "changed"), deep, made.block_paths(scratch)).mapInArrow(run, schema)


def lowered(column: Column) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(column, LETTERS, LETTERS.lower())


def per_document(docs: DataFrame, deep: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; where 3 divides the CRC of an id, the text was changed to lower case after the manifest was made."""
    columns = {c: F.col(c) for c in FIELDS}
    hit = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))
    changed = F.when(hit, leaf([lowered(columns["text"]) if c == "text" else columns[c] for c in FIELDS]))
    leaves = docs.select(F.col("lang").alias("key"), F.col("doc_id").alias("at"), leaf(list(columns.values())).alias("digest"), changed.alias("changed"))
    with Scratch(docs.sparkSession) as scratch:
        return written(folded(scratch, build(scratch, scratch.written(leaves), deep=deep))).withColumnRenamed("at", "doc_id")


def _oracle(deep: int = 7, wide: int = 3) -> str:
    """The manifest in SQL, for up to 8 ** deep rows of a key and 8 ** wide keys."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    of = lambda text: "sha256(" + " || ".join(part(c) for c in FIELDS).replace(part("text"), part(text)) + ")"
    lower = f"translate(text, '{LETTERS}', '{LETTERS.lower()}')"
    sql = [
        f"""WITH a0 AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {of('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {of(lower)} ELSE {of('text')} END AS f FROM documents),
        b0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM a0), x0 AS (SELECT g, i, leaf AS d, doc_id, leaf, f, '' AS p, i AS j FROM b0), n0 AS (SELECT DISTINCT g, i, d FROM x0)"""
    ]
    k = 0

    def climb(times: int) -> None:
        nonlocal k
        for _ in range(times):
            sql.append(
                f"""c{k} AS (SELECT g, i // {FAN} AS i, string_agg(d, '' ORDER BY i) AS s, count(*) AS c, sum(count(*)) OVER (PARTITION BY g) AS n FROM n{k} GROUP BY g, i // {FAN}),
        n{k + 1} AS (SELECT g, i, CASE WHEN n > 1 THEN sha256(s) ELSE s END AS d FROM c{k}),
        x{k + 1} AS (SELECT x.g, x.doc_id, x.leaf, c.i, x.j // {FAN} AS j, CASE WHEN n > 1 THEN sha256(substr(s, 1, 64 * (x.j % {FAN})::BIGINT) || x.f || substr(s, 64 * (x.j % {FAN})::BIGINT + 65)) ELSE x.f END AS f,
          CASE WHEN n > 1 THEN p || substr(s, 1, 64 * (x.j % {FAN})::BIGINT) || substr(s, 64 * (x.j % {FAN})::BIGINT + 65) ELSE p END AS p FROM x{k} AS x JOIN c{k} AS c ON c.g = x.g AND c.i = x.j // {FAN})"""
            )
            k += 1

    climb(deep)
    sql.append(f"t AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS i FROM n{k}), n{k + 1} AS (SELECT '' AS g, i, d FROM t), x{k + 1} AS (SELECT '' AS g, x.doc_id, x.leaf, t.i, t.i AS j, x.f, x.p FROM x{k} AS x JOIN t ON t.g = x.g)")
    k += 1
    climb(wide)
    return ",\n".join(sql) + f" SELECT x.doc_id, x.leaf, s.d AS subroot, r.d AS root, sha256(x.p) AS proof_sha256, x.f AS folded_root, x.f = r.d AS verified FROM x{k} AS x JOIN a0 ON a0.doc_id = x.doc_id JOIN t AS s ON s.g = a0.g, n{k} AS r"


ORACLE = _oracle()

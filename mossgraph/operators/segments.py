"""Tables that change together: immutable segments and versioned manifests.

A table is a list of segments, oldest first. A segment has rows, and keys that are gone: rows of such a key in earlier
segments no longer count. A change writes segments and then commits one manifest that has them all, so readers see all of it or
nothing, and whatever fails before leaves the old version. A manifest is a small file whose name is its version; it
takes its place by an operation that fails if the name is taken, so of two writers one gets ``Conflict`` and
starts again from the newer version.

Segments of a table that have grown to similar sizes are merged by ``compact``, next to each other only, as their order matters.
A segment can be partitioned by a column; into how many parts is its own affair and stands in the manifest.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT, SMALLEST = 4, 1 << 20
ROWS_A_PART, MOST_PARTS = 200_000, 1024


class Conflict(Exception):
    """Another writer has taken the version."""


@dataclass(frozen=True)
class Segment:
    name: str
    bytes: int
    parts: int  #: how many values the partition column can have; 0 without one
    gone: bool  #: whether it has keys that are gone


@dataclass(frozen=True)
class Spec:
    key: str
    part: str | None = None
    sort: tuple[str, ...] = ()


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: dict[str, list[Segment]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    info: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Change:
    """Segments to append, by table, and what to set in ``info``."""

    segments: dict[str, list[Segment]] = field(default_factory=dict)
    schemas: dict[str, dict] = field(default_factory=dict)
    info: dict = field(default_factory=dict)

    def __add__(self, other: Change) -> Change:
        tables = self.segments.keys() | other.segments.keys()
        return Change({t: self.segments.get(t, []) + other.segments.get(t, []) for t in tables}, self.schemas | other.schemas, self.info | other.info)


def parts_for(rows: int) -> int:
    """A power of two that grows with the rows."""
    return min(MOST_PARTS, 1 << max(0, math.ceil(math.log2(max(1, rows) / ROWS_A_PART)))) if rows > ROWS_A_PART else 1


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)).cast("int")


def among(rows: DataFrame, keys: DataFrame, key: str, part: str, s: Segment) -> DataFrame:
    """``rows`` of a segment whose ``key`` is one of ``keys`` (written); only the parts that those fall into are read."""
    dealt = keys.select(key, part_of(F.col(key), s.parts).alias(part))
    if s.parts > 1:
        held = [r[0] for r in dealt.select(part).distinct().collect()]  # MOST_PARTS at most
        rows = rows.where(F.col(part).isin(*held)) if held else rows.limit(0)
    return rows.join(dealt.select(key).distinct(), key, "left_semi").drop(part)


class Tables:
    def __init__(self, spark: SparkSession, folder: str, specs: dict[str, Spec]):
        self.spark, self.folder, self.specs = spark, folder.rstrip("/"), specs
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    # versions

    def version(self) -> int:
        """The newest one; 0 before the first. One listing of the folder of manifests."""
        where = self._path(f"{self.folder}/versions")
        if not self._fs.exists(where):
            return 0
        return max((int(n) for s in self._fs.listStatus(where) if (n := s.getPath().getName()).isdigit()), default=0)

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.version() if version is None else version
        if not version:
            return Manifest()
        stream = self._fs.open(self._path(f"{self.folder}/versions/{version:012d}"))
        try:
            made = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Manifest(version, {t: [Segment(**s) for s in segments] for t, segments in made["segments"].items()}, made["schemas"], made["info"])

    def commit(self, base: Manifest, change: Change) -> Manifest:
        """``base`` and ``change`` as the next version, or ``Conflict``."""
        segments = base.segments | {t: [*base.segments.get(t, []), *new] for t, new in change.segments.items()}
        return self._take(Manifest(base.version + 1, segments, change.schemas | base.schemas, base.info | change.info))

    def _take(self, made: Manifest) -> Manifest:
        body = json.dumps({"segments": {t: [asdict(s) for s in segments] for t, segments in made.segments.items()}, "schemas": made.schemas, "info": made.info})
        target, draft = (self._fs.makeQualified(self._path(f"{self.folder}/{x}")) for x in (f"versions/{made.version:012d}", f"drafts/{uuid.uuid4().hex}"))
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(body.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a rename would replace a file; a link to a name that is taken fails
                local = self._jvm.java.nio.file.Paths.get
                self._jvm.java.nio.file.Files.createLink(local(target.toUri()), local(draft.toUri()))
            elif self._fs.exists(target) or not self._fs.rename(draft, target):
                raise Conflict(str(target))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(str(target)) from e
            raise
        finally:
            self._fs.delete(draft, False)
        return made

    def apply(self, change: Callable[[Manifest], Change]) -> Manifest:
        """Commits what ``change`` makes of the newest version, again if another writer was faster."""
        while True:
            base = self.manifest()
            try:
                return self.commit(base, change(base))
            except Conflict:
                continue

    # segments

    def stage(self, table: str, rows: DataFrame, gone: DataFrame | None = None, parts: int = 0) -> Change:
        """Writes a segment, which counts once it is committed: ``rows`` (with the partition column, if the table has one) and the keys that are gone.

        Files of a partitioned table are in the order of its ``sort``, so that a scan skips row groups by it."""
        spec, name = self.specs[table], uuid.uuid4().hex
        where = f"{self.folder}/{table}/{name}"
        if spec.part:
            rows.hint("rebalance", spec.part).sortWithinPartitions(spec.part, *spec.sort).write.partitionBy(spec.part).parquet(f"{where}/rows")
        else:
            rows.write.parquet(f"{where}/rows")
        if gone is not None:
            gone.select(spec.key).distinct().write.parquet(f"{where}/gone")
        size = self._fs.getContentSummary(self._path(f"{where}/rows")).getLength()
        return Change({table: [Segment(name, size, parts, gone is not None)]}, {table: rows.schema.jsonValue()})

    def _gone(self, table: str, segments: Iterable[tuple[int, Segment]], kind: T.DataType) -> DataFrame | None:
        key = self.specs[table].key
        read = self.spark.read.schema(T.StructType([T.StructField(key, kind)]))
        found = [read.parquet(f"{self.folder}/{table}/{s.name}/gone").withColumn("_last", F.lit(n)) for n, s in segments if s.gone]
        return reduce(DataFrame.unionByName, found) if found else None

    def read(self, manifest: Manifest, table: str, each: Callable[[DataFrame, Segment], DataFrame] | None = None, segments: list[Segment] | None = None) -> DataFrame | None:
        """The rows that count; None if the table was never written. ``each`` is applied to the rows of a segment first, to prune them by the parts that it has."""
        if table not in manifest.schemas:
            return None
        spec, schema = self.specs[table], T.StructType.fromJson(manifest.schemas[table])
        numbered = list(enumerate(manifest.segments[table] if segments is None else segments))
        scans = []
        for n, s in numbered:
            rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/{s.name}/rows")
            scans.append((rows if each is None else each(rows, s)).withColumn("_segment", F.lit(n)))
        rows = reduce(DataFrame.unionByName, scans)
        gone = self._gone(table, numbered[1:], schema[spec.key].dataType)  # what the first one lacks is nowhere
        if gone is not None:
            last = gone.groupBy(F.col(spec.key).alias("_key")).agg(F.max("_last").alias("_last"))
            rows = rows.join(last, (F.col(spec.key) == F.col("_key")) & (F.col("_segment") < F.col("_last")), "left_anti")
        return rows.drop("_segment")

    # merging

    def _run(self, segments: list[Segment], fanout: int) -> list[Segment]:
        """Neighbours to merge: at least ``fanout`` whose sizes are at most those of one tier, of the lowest tier that has such."""
        tier = lambda s: 0 if s.bytes <= SMALLEST else 1 + math.floor(math.log(s.bytes / SMALLEST, fanout))
        for top in sorted({tier(s) for s in segments}):
            for small, run in groupby(segments, key=lambda s: tier(s) <= top):
                if small and len(held := list(run)) >= fanout:
                    return held
        return []

    def compact(self, table: str, repart: Callable[[DataFrame, int], DataFrame] | None = None, fanout: int = FANOUT) -> Manifest:
        """Merges runs of similar segments until there is none. ``repart`` sets the partition column for so many parts."""
        while run := self._run((base := self.manifest()).segments.get(table, []), fanout):
            rows = self.read(base, table, segments=run)
            gone = None
            if run[0] != base.segments[table][0]:  # older rows stay hidden
                gone = self._gone(table, enumerate(run), T.StructType.fromJson(base.schemas[table])[self.specs[table].key].dataType)
            parts = max(s.parts for s in run)
            if self.specs[table].part and repart:
                parts = max(parts, parts_for(rows.count()))
                rows = repart(rows, parts)
            merged = self.stage(table, rows, gone, parts).segments[table]

            while True:
                segments = base.segments[table]
                at = next((i for i in range(len(segments)) if segments[i : i + len(run)] == run), None)
                if at is None:  # another writer has merged some of them
                    break
                try:
                    self._take(replace(base, version=base.version + 1, segments=base.segments | {table: segments[:at] + merged + segments[at + len(run) :]}))
                    break
                except Conflict:
                    base = self.manifest()
        return self.manifest()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the versions before the last ``keep``, and the segments that only those have."""
        last = self.version()
        names = lambda versions: {(t, s.name) for v in versions if self._fs.exists(self._path(f"{self.folder}/versions/{v:012d}")) for t, segments in self.manifest(v).segments.items() for s in segments}
        old = range(1, last - keep + 1)
        for table, name in names(old) - names(range(max(1, last - keep + 1), last + 1)):
            self._fs.delete(self._path(f"{self.folder}/{table}/{name}"), True)
        for v in old:
            self._fs.delete(self._path(f"{self.folder}/versions/{v:012d}"), False)

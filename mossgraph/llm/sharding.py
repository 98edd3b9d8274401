"""Size-tiered shards: arrivals become small immutable runs, similar runs are merged, manifests are versioned.

A store is a folder of runs and manifests. ``append`` writes a run and commits a manifest that adds it.
``compact`` merges a tier once it has ``fanout`` runs: a tier holds the runs whose bytes lie within one power
of ``fanout``. A merged run has files of about ``file_bytes``. Several
arrivals that come in one table are written as runs by one job (``append_parts``). A manifest is written beside its place and
renamed to the next version; the rename fails if another writer has taken that version, and the loser starts
again from the newer one. Readers read one version and never see half a change.

Rows are dealt out round robin, so equal rows and hot keys spread over all files. Nulls, empty texts, repeated
rows and any columns are kept as they are; appending an empty table commits a run without rows.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MANIFEST = T.StructType([T.StructField("run", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("files", T.LongType()), T.StructField("merged", T.LongType())])


@dataclass(frozen=True)
class Run:
    run: str
    bytes: int
    files: int
    merged: int  #: how many runs have gone into it


class Conflict(Exception):
    """Another writer has committed this version."""


def _free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column has it in any case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, fanout: int = 4, file_bytes: int = 128 << 20, smallest: int = 1 << 20):
        self.spark, self.folder, self.schema = spark, folder, schema
        self.fanout, self.file_bytes, self.smallest = fanout, file_bytes, smallest
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        where = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(where):
            return 0
        return max((int(n[1:]) for s in self._fs.listStatus(where) if (n := s.getPath().getName()).startswith("v")), default=0)

    def runs(self, version: int | None = None) -> list[Run]:
        version = self.version() if version is None else version
        if not version:
            return []
        return [Run(**r.asDict()) for r in self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifests/v{version}").orderBy("run").collect()]

    def commit(self, base: int, runs: list[Run]) -> int:
        """Makes ``runs`` version ``base + 1``, or raises Conflict."""
        made = f"{self.folder}/uncommitted/{uuid.uuid4().hex}"
        rows = F.array(*(F.struct(F.lit(r.run).alias("run"), F.lit(r.bytes).cast("long").alias("bytes"), F.lit(r.files).cast("long").alias("files"), F.lit(r.merged).cast("long").alias("merged")) for r in runs)).cast("array<struct<run:string,bytes:bigint,files:bigint,merged:bigint>>")
        self.spark.range(1).select(F.inline(rows)).coalesce(1).write.parquet(made)
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))
        target = self._path(f"{self.folder}/manifests/v{base + 1}")
        if self._fs.exists(target) or not self._fs.rename(self._path(made), target):
            raise Conflict(str(target))
        if self._fs.exists(self._path(f"{target}/{made.rpartition('/')[2]}")):  # a rename into a folder that came up meanwhile
            self._fs.delete(self._path(f"{target}/{made.rpartition('/')[2]}"), True)
            raise Conflict(str(target))
        return base + 1

    # writing

    def _written(self, rows: DataFrame, files: int | None, merged: int) -> Run:
        run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        (rows.repartition(files) if files else rows).write.parquet(f"{self.folder}/runs/{run}")
        return self._found(run, merged)

    def _found(self, run: str, merged: int) -> Run:
        size = self._fs.getContentSummary(self._path(f"{self.folder}/runs/{run}"))
        return Run(run, size.getLength(), sum(s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._path(f"{self.folder}/runs/{run}"))), merged)

    def _committed(self, change) -> int:
        while True:
            base = self.version()
            try:
                return self.commit(base, change(self.runs(base)))
            except Conflict:
                continue

    def append(self, rows: DataFrame) -> int:
        """Adds ``rows`` as one run; returns the version."""
        new = self._written(rows.select(*(F.col(f"`{c}`") for c in self.schema.fieldNames())), None, 1)
        return self._committed(lambda runs: [*runs, new])

    def append_parts(self, rows: DataFrame, part: Column) -> Iterator[int]:
        """Adds ``rows`` as one run for each value of ``part``, null included; one job writes them all, and the next is committed when
        its version is asked for."""
        stem, column = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}", _free("part", self.schema.fieldNames())
        folder = f"{self.folder}/runs/{stem}"
        rows.select(*(F.col(f"`{c}`") for c in self.schema.fieldNames()), part.alias(column)).write.partitionBy(column).parquet(folder)
        for name in sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()):
            new = self._found(f"{stem}/{name}", 1)
            yield self._committed(lambda runs, new=new: [*runs, new])

    def tier(self, run: Run) -> int:
        return max(0, math.floor(math.log(max(1, run.bytes) / self.smallest, self.fanout))) if run.bytes > self.smallest else 0

    def full_tier(self, runs: list[Run]) -> list[Run]:
        """The runs of the lowest tier that has ``fanout`` of them, oldest first."""
        tiers: dict[int, list[Run]] = {}
        for r in sorted(runs, key=lambda r: r.run):
            tiers.setdefault(self.tier(r), []).append(r)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merges full tiers until there is none; returns the version. The files of merged runs stay for readers of older versions."""
        while old := self.full_tier(self.runs()):
            size = sum(r.bytes for r in old)
            new = self._written(self._read(old), max(1, math.ceil(size / self.file_bytes)), sum(r.merged for r in old))
            gone = {r.run for r in old}

            def change(runs: list[Run], gone: set[str] = gone, new: Run = new) -> list[Run]:
                if not gone <= {r.run for r in runs}:  # another compaction has merged some of them
                    return runs
                return [*(r for r in runs if r.run not in gone), new]

            self._committed(change)
        return self.version()

    def vacuum(self, keep: int = 1) -> None:
        """Deletes the manifests before the last ``keep``, and the runs that only those have."""
        version = self.version()
        kept = {r.run for v in range(max(1, version - keep + 1), version + 1) for r in self.runs(v)}
        old = {r.run for v in range(1, version - keep + 1) if self._fs.exists(self._path(f"{self.folder}/manifests/v{v}")) for r in self.runs(v)}
        for run in old - kept:
            self._fs.delete(self._path(f"{self.folder}/runs/{run}"), True)
        for v in range(1, version - keep + 1):
            self._fs.delete(self._path(f"{self.folder}/manifests/v{v}"), True)

    # reading

    def _read(self, runs: list[Run]) -> DataFrame:
        if not runs:
            return self.spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema))
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/runs/{r.run}" for r in runs))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest if none is given."""
        return self._read(self.runs(version))


#: The query appends the table in so many arrivals.
ARRIVALS = 8


def compacted(spark: SparkSession, docs: DataFrame, folder: str, arrivals: int = ARRIVALS) -> DataFrame:
    """``docs`` as the store has them after arriving in parts, compacted after each: doc_id, lang, source, n_chars, text_sha256."""
    store = ShardStore(spark, folder, docs.schema)
    for _ in store.append_parts(docs, F.pmod(F.xxhash64("doc_id", "text"), F.lit(arrivals))):
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


ORACLE = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"

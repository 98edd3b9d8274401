"""A stored full-text index: postings pruned by term, statistics, and documents for filters and snippets.

Its tables are ``segments``. A change writes one segment with the changed documents and the ids that it supersedes, and reads,
of what is there, the lengths of those ids alone. The statistics are sums in the manifest to which every change adds
its own and from which it takes those of the rows that it supersedes. Segments of similar size are merged by ``compact``, without a rebuild.

Postings are partitioned by a hash of the term and carry the length of their document's field, so a query reads the partitions of
its words and joins no lengths. Documents are partitioned by a hash of the id, by which a page of hits is joined.
How many partitions a segment has grows with its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import term_count, terms
from .search import query_terms, scores_of
from .segments import Change, Manifest, Segment, Spec, Tables, among, part_of, parts_for

ATTRIBUTES = ["id", "collection", "tags", "fm_terms"]
SPECS = {"postings": Spec("id", "bucket", ("field", "term")), "documents": Spec("id", "part")}


class StoredIndex:
    """``fields`` are tokenised columns; tags are terms as a whole and have no length. Null fields have no terms.

    ``at`` holds a version still; without it every call sees the newest. ``tables`` can be those of a store that has the index's among others."""

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str] = ("title", "content"), content: str = "content", buckets: int | None = None, at: Manifest | None = None, tables: Tables | None = None):
        self.spark, self.folder, self.fields, self.content, self.buckets, self.at = spark, folder.rstrip("/"), tuple(fields), content, buckets, at
        self.tables = tables or Tables(spark, folder, SPECS)

    def pinned(self) -> StoredIndex:
        """The index as it is now, whatever is added later."""
        return self if self.at else StoredIndex(self.spark, self.folder, self.fields, self.content, self.buckets, self.tables.manifest(), self.tables)

    def _manifest(self) -> Manifest:
        return self.at or self.tables.manifest()

    @property
    def segments(self) -> int:
        return len(self._manifest().segments.get("documents", []))

    # changes

    def add(self, docs: DataFrame, removed: DataFrame | None = None) -> StoredIndex:
        """``docs`` (id, collection, tags, fm_terms and the fields, one row per id) come or take the place of what their ids had; ``removed`` (id) go. ``docs`` are read three times, so write them first if they are costly to make."""
        staged = self.staged(docs, removed)
        self.tables.apply(lambda base: self.change(base, staged))
        return self

    def staged(self, docs: DataFrame, removed: DataFrame | None = None) -> tuple[Change, dict[str, list[int]], DataFrame]:
        """The segments of a change, written but not committed; its sums of lengths, and the ids that it supersedes."""
        rows = docs.count()
        parts = self.buckets or parts_for(rows)
        kept = [*ATTRIBUTES, *dict.fromkeys([*self.fields, self.content])]
        lengths = F.struct(*(term_count(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in self.fields), F.coalesce(F.size("tags"), F.lit(0)).alias("tags"))
        gone = docs.select("id") if removed is None else docs.select("id").unionByName(removed.select("id"))
        documents = self.tables.stage("documents", docs.select(*kept, lengths.alias("lengths"), part_of(F.col("id"), parts).alias("part")), gone, parts)
        new = self.tables.read(Manifest(0, documents.segments, documents.schemas), "documents")
        come = self._sums(new)
        parts = self.buckets or parts_for(sum(length for _, length in come.values()))
        postings = self.tables.stage("postings", self._postings_of(docs, rows == new.select("id").distinct().count()).withColumn("bucket", part_of(F.col("term"), parts)), gone, parts)
        segment = documents.segments["documents"][0]
        return documents + postings, come, self.spark.read.schema(new.select("id").schema).parquet(f"{self.tables.folder}/documents/{segment.name}/gone")

    def change(self, base: Manifest, staged: tuple[Change, dict[str, list[int]], DataFrame]) -> Change:
        """A staged change against ``base``: its segments, and the sums of lengths with what it brings and without what it supersedes."""
        change, come, gone = staged
        had = self._documents(base, lambda rows, s: among(rows.select("id", "lengths", "part"), gone, "id", "part", s)) if base.version else None
        before = base.info.get("statistics", {})
        went = self._sums(had) if had is not None else {}
        out = {f: [before.get(f, [0, 0])[k] + come[f][k] - went.get(f, [0, 0])[k] for k in (0, 1)] for f in come}
        return change + Change(info={"statistics": out})

    def _sums(self, docs: DataFrame) -> dict[str, list[int]]:
        """How many documents have a field, and its length in all of them."""
        names = [*self.fields, "tags"]
        found = docs.agg(*(F.struct(F.count_if(F.col("lengths")[f] > 0), F.coalesce(F.sum(F.col("lengths")[f]), F.lit(0))).alias(f"f{k}") for k, f in enumerate(names))).first()
        return {f: [int(x) for x in found[f"f{k}"]] for k, f in enumerate(names)}

    def compact(self) -> StoredIndex:
        """Merges segments of similar size; statistics stay as they are."""
        self.tables.compact("documents", lambda rows, n: rows.withColumn("part", part_of(F.col("id"), n)))
        self.tables.compact("postings", lambda rows, n: rows.withColumn("bucket", part_of(F.col("term"), n)))
        return self

    def _postings_of(self, docs: DataFrame, once: bool) -> DataFrame:
        """field, term, id, length and tf. A document's terms are put in order and counted where they are made; rows that share an id are summed up unless ids come ``once``."""
        held = docs.select("id", "tags", *(F.sort_array(terms(F.coalesce(F.col(f), F.lit("")))).alias(f"_{n}") for n, f in enumerate(self.fields)))

        def firsts(c: str) -> Column:
            return F.filter(F.transform(c, lambda t, i: F.struct(t.alias("term"), i.alias("at"))), lambda x: (x["at"] == 0) | (x["term"] != F.get(F.col(c), x["at"] - 1)))

        def row(field: str, term: Column, length: Column, tf: Column) -> Column:
            return F.struct(F.lit(field).alias("field"), term.alias("term"), length.alias("length"), tf.cast("int").alias("tf"))

        held = held.select("id", "tags", *(F.size(f"_{n}").alias(f"_n{n}") for n in range(len(self.fields))), *(firsts(f"_{n}").alias(f"_f{n}") for n in range(len(self.fields))))
        of = lambda n, f: F.transform(f"_f{n}", lambda x, i: row(f, x["term"], F.col(f"_n{n}"), F.coalesce(F.get(F.col(f"_f{n}"), i + 1)["at"], F.col(f"_n{n}")) - x["at"]))
        tagged = F.transform(F.coalesce(F.array_distinct("tags"), F.array().cast("array<string>")), lambda t: row("tags", t, F.lit(1), F.lit(1)))
        rows = held.select("id", F.inline(F.concat(*(of(n, f) for n, f in enumerate(self.fields)), tagged)))
        return rows.select("field", "term", "id", "length", "tf") if once else rows.groupBy("field", "term", "id", "length").agg(F.sum("tf").cast("int").alias("tf"))

    # reading

    def _documents(self, base: Manifest, each=None) -> DataFrame | None:
        return self.tables.read(base, "documents", each)

    def documents(self) -> DataFrame:
        return self._documents(self._manifest()).drop("lengths", "part")

    def statistics(self) -> DataFrame:
        """field, docs (those that have it) and avg_length; a row per field that any document has."""
        known = {f: s for f, s in self._manifest().info.get("statistics", {}).items() if s[0]}
        rows = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(n).cast("long").alias("docs"), F.lit(total / n).alias("avg_length")) for f, (n, total) in known.items())).cast("array<struct<field:string,docs:bigint,avg_length:double>>")
        return self.spark.range(1).select(F.inline(rows))

    def hits(self, words: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
        """field, term, id, length and tf of these terms."""

        def each(rows: DataFrame, s: Segment) -> DataFrame:
            if not words:
                return rows.limit(0)
            found = rows.where(F.col("bucket").isin(*sorted({zlib.crc32(w.encode()) % s.parts for w in words})) & F.col("term").isin(*words))
            return found if fields is None else found.where(F.col("field").isin(*fields))

        return self.tables.read(self._manifest(), "postings", each).drop("bucket")

    def scores(self, query: str, keep: Column | None = None, fields: Sequence[str] | None = None) -> DataFrame:
        """id and score of what has a term of the query; fields add up. Document frequencies don't depend on ``keep``."""
        index = self.pinned()
        rows = index.hits(query_terms(query), fields)
        df = rows.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row per word and field at most
        if keep is not None:
            rows = rows.join(index.documents().where(keep).select("id"), "id", "left_semi")
        return scores_of(rows, df, index.statistics())

    def contents_of(self, page: DataFrame) -> DataFrame:
        """``page`` (id, ...), which is a request's page and so small, with ``_content``."""

        def each(rows: DataFrame, s: Segment) -> DataFrame:
            small = F.broadcast(page.select("id", part_of(F.col("id"), s.parts).alias("part")))
            return rows.select("id", "part", F.col(self.content).alias("_content")).join(small, ["part", "id"], "left_semi").drop("part")

        return self._documents(self._manifest(), each).join(F.broadcast(page), "id", "right")

"""Point reads, listings and pages of documents and their history."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cursor as encoded
from ..model import MAX_BATCH, MAX_DELETED_PAGE, MAX_OFFSET, MAX_PAGE, InvalidRequest, bounded


@dataclass(frozen=True)
class Page:
    """A page's rows, and lazily: how many match in all, and whether more follow."""

    items: DataFrame
    matching: DataFrame
    limit: int
    more: DataFrame | None = None  #: one row: has_more

    def next_cursor(self, id: str = "id") -> DataFrame:
        """One row: the cursor of the last item returned, null unless more follow."""
        last = self.items.agg(F.max(id).cast("string").alias("_last"))
        return last.join(F.broadcast(self.more)).select(F.when(F.col("has_more"), encoded(F.col("_last"))).alias("next_cursor")) if self.more is not None else last.select(F.lit(None).cast("string").alias("next_cursor"))

    @property
    def total(self) -> DataFrame:
        return self.matching.agg(F.count("*").alias("total"))


def live(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("deleted"))


def read(docs: DataFrame, key: Any, id: str = "id", with_deleted: bool = False) -> DataFrame:
    return (docs if with_deleted else live(docs)).where(F.col(id) == F.lit(key))


def read_many(docs: DataFrame, keys: Sequence[Any], id: str = "id") -> DataFrame:
    """The live documents of ``keys``, each once, in the keys' order, with ``pos``; at most a batch of keys."""
    bounded("keys", len(keys), 0, MAX_BATCH)
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    wanted = docs.sparkSession.range(1).select(F.explode(F.array(*(F.struct(F.lit(k).alias(id), F.lit(i).alias("pos")) for k, i in first.items())) if first else F.array().cast(f"array<struct<{id}:{docs.schema[id].dataType.simpleString()},pos:int>>")).alias("w")).select("w.*")
    return live(docs).join(F.broadcast(wanted), id).orderBy("pos")


def listed(docs: DataFrame, collections: Sequence[str] | None = None, with_deleted: bool = False, id: str = "id") -> DataFrame:
    rows = docs if with_deleted else live(docs)
    return (rows.where(F.col("collection").isin(*collections)) if collections is not None else rows).orderBy(id)


def tombstones(docs: DataFrame, collection: str | None = None, id: str = "id") -> DataFrame:
    rows = docs.where("deleted")
    return (rows.where(F.col("collection") == collection) if collection else rows).orderBy(id)


def deleted_page(docs: DataFrame, limit: int, collection: str | None = None, id: str = "id") -> DataFrame:
    return tombstones(docs, collection, id).limit(min(bounded("limit", limit, 1, MAX_PAGE), MAX_DELETED_PAGE))


def under(path: Column, prefix: str) -> Column:
    """Literal prefix: nothing in it is a pattern."""
    return F.startswith(path, F.lit(prefix))


def offset_page(rows: DataFrame, offset: int, limit: int, order: Sequence[str | Column] = ("id",)) -> Page:
    bounded("limit", limit, 1, MAX_PAGE)
    bounded("offset", offset, 0, MAX_OFFSET)
    window = rows.orderBy(*order).offset(offset)
    return Page(window.limit(limit), rows, limit, window.limit(limit + 1).agg((F.count("*") > limit).alias("has_more")))


def keyset_page(rows: DataFrame, after: Any, limit: int, id: str = "id") -> Page:
    """The rows whose id follows ``after``; the total is of all rows that match, before the cursor too."""
    bounded("limit", limit, 1, MAX_PAGE)
    rest = rows if after is None else rows.where(F.col(id) > F.lit(after))
    return Page(rest.orderBy(id).limit(limit), rows, limit, rest.orderBy(id).limit(limit + 1).agg((F.count("*") > limit).alias("has_more")))


def page(rows: DataFrame, limit: int, offset: int | None = None, cursor: Any = None, id: str = "id") -> Page:
    """A page by cursor or by offset, not both."""
    if cursor is not None and offset:
        raise InvalidRequest("give a cursor or an offset, not both")
    return keyset_page(rows, cursor, limit, id) if cursor is not None else offset_page(rows, offset or 0, limit, (id,))


def history(revisions: DataFrame, doc: Any, offset: int, limit: int) -> Page:
    return offset_page(revisions.where(F.col("doc_id") == F.lit(doc)), offset, limit, ("created_at", "revision"))


def composed_history(revisions: DataFrame, renames: DataFrame) -> DataFrame:
    """``revisions`` with those of former ids under the present one; renames: old_id, new_id."""
    moved = revisions.join(renames.select(F.col("old_id").alias("doc_id"), "new_id"), "doc_id").withColumn("doc_id", F.col("new_id")).drop("new_id")
    return revisions.unionByName(moved.select(*revisions.columns))


def references(docs: DataFrame) -> DataFrame:
    """What a listing shows of a document."""
    return docs.select("id", "collection", "path", "content_hash", "revision", "updated_at")

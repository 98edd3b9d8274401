"""A search request, checked, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import highlights, is_han, snippet
from ..model import MAX_OFFSET, MAX_PAGE, MAX_QUERY_BYTES, MAX_TAGS, InvalidRequest, bounded
from ..operators import search
from ..operators.index import StoredIndex
from ..operators.search import Filters, query_terms

#: The score of pending documents that match, and the length of their snippets.
PENDING_SCORE, PENDING_SNIPPET = 1.7976931348623157e308, 160

MODES = ("lexical", "vector", "hybrid")


@dataclass(frozen=True)
class SearchRequest:
    query: str = ""
    filters: Filters = Filters()
    mode: str = "lexical"
    limit: int = 20
    offset: int = 0
    vector: Sequence[float] | None = None
    candidates: int = 0  #: how deep each ranking goes into a fusion

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise InvalidRequest(f"unknown mode {self.mode!r}")
        if len(self.query.encode()) > MAX_QUERY_BYTES:
            raise InvalidRequest("query too long")
        if len(self.filters.tags) > MAX_TAGS:
            raise InvalidRequest("too many tags")
        bounded("limit", self.limit, 1, MAX_PAGE)
        bounded("offset", self.offset, 0, MAX_OFFSET)


def plan(request: SearchRequest, docs: DataFrame, vectors: DataFrame | None = None, scope: Sequence[str] | None = None, text: str = "text", id: str = "id") -> DataFrame:
    """id and score of the page. Without a query but with filters, all that pass have score 0; without either there is no answer.

    A hybrid search without vectors, or without a vector to compare, is a lexical one."""
    asked = bool(request.filters)
    filters = request.filters.within(scope)
    keep = filters.predicate() if filters else None
    if not request.query.strip() and request.vector is None:
        rows = docs.where(keep) if asked else docs.limit(0)
        return search.top(rows.select(id, F.lit(0.0).alias("score")), request.limit, request.offset, id)
    lexical = lambda: search.scan_scores(docs, request.query, text, id, keep).select(id, "score")
    if request.mode == "lexical" or vectors is None or request.vector is None:
        return search.top(lexical(), request.limit, request.offset, id)
    near = search.vector_scores(vectors.join(docs.where(keep).select(id), id, "left_semi") if keep is not None else vectors, request.vector, id)
    if request.mode == "vector":
        return search.top(near, request.limit, request.offset, id)
    depth = max(request.offset + request.limit + 1, request.candidates)
    return search.top(search.fused([lexical(), near], depth, depth, id), request.limit, request.offset, id)


def _match(content: Column, words: Sequence[str]) -> Column:
    """Where the first of the words stands, 0 if none does; an ideograph needs no other letter's end."""
    han = [w for w in words if is_han(w)]
    runs = [w for w in words if w not in han]
    letter = r"[\p{L}\p{N}&&[^\p{IsHan}]]"
    parts = [rf"(?<!{letter})(?:{'|'.join(runs)})(?!{letter})"] if runs else []
    return F.regexp_instr(F.lower(content), F.lit("|".join([*parts, *han])))


def answer(request: SearchRequest, index: StoredIndex, vectors: DataFrame | None = None, pending: DataFrame | None = None, scope: Sequence[str] | None = None) -> DataFrame:
    """The page of a request from a stored index: id, score, snippet, highlights and has_more.

    Statistics, filters and the fallback of a hybrid search are those of ``plan``; title, content and tags are searched.
    Pending documents (id, collection, tags, fm_terms, deleted and the content) hide what is indexed under their ids;
    those that have the query as a substring come first, with the head of their content."""
    index, filters = index.pinned(), request.filters.within(scope)
    keep = filters.predicate() if filters else None
    if not request.query.strip() and request.vector is None:
        rows = index.documents().where(keep) if request.filters else index.documents().limit(0)
        scored = rows.select("id", F.lit(0.0).alias("score"))
    else:
        lexical = index.scores(request.query, keep)
        if request.mode == "lexical" or vectors is None or request.vector is None:
            scored = lexical
        else:
            near = search.vector_scores(vectors.join(index.documents().where(keep).select("id"), "id", "left_semi") if keep is not None else vectors, request.vector)
            depth = max(request.offset + request.limit + 1, request.candidates)
            scored = near if request.mode == "vector" else search.fused([lexical, near], depth, depth)
    if pending is not None:
        mine = pending if keep is None else pending.where(keep)
        fresh = mine.where(~F.col("deleted") & F.contains(F.lower(F.col(index.content)), F.lit(request.query.lower()))) if request.query.strip() else mine.limit(0)
        scored = search.superseded(scored, pending).unionByName(fresh.select("id", F.lit(PENDING_SCORE).alias("score")))
    page = search.top_with_more(scored, request.limit, request.offset)
    words = query_terms(request.query)
    shown = index.contents_of(page)
    if pending is not None:
        shown = shown.join(F.broadcast(pending.join(F.broadcast(page.select("id")), "id", "left_semi").select("id", F.col(index.content).alias("_new"))), "id", "left").withColumn("_content", F.coalesce("_new", "_content"))
    if not words:
        return shown.select("id", "score", F.substring("_content", 1, 200).alias("snippet"), F.array().cast("array<struct<start:int,end:int>>").alias("highlights"), "has_more")
    piece = F.when(F.col("score") == PENDING_SCORE, F.substring("_content", 1, PENDING_SNIPPET)).otherwise(snippet(F.col("_content"), _match(F.col("_content"), words)))
    return shown.withColumn("snippet", piece).select("id", "score", "snippet", highlights(F.col("snippet"), F.col("_content"), words).alias("highlights"), "has_more")


def total(index: StoredIndex, filters: Filters = Filters(), pending: DataFrame | None = None) -> DataFrame:
    """How many documents a listing has: indexed ones without those that pending ones hide, and the pending ones that are not deleted."""
    keep = filters.predicate() if filters else F.lit(True)
    rows = index.documents().where(keep).select("id")
    if pending is not None:
        rows = search.superseded(rows, pending).unionByName(pending.where(keep & ~F.col("deleted")).select("id"))
    return rows.agg(F.count("*").alias("n"))

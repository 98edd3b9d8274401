"""Lexical, vector and hybrid top-k with typed filters.

Statistics of the corpus never depend on filters; filters apply before scores are made and ranked.
Every ranking is total: score descending, id ascending.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frontmatter import fm_filter
from ..functions.text import terms

K1, B, RRF = 1.2, 0.75, 60


@dataclass(frozen=True)
class Filters:
    collections: frozenset[str] = frozenset()
    tags: frozenset[str] = frozenset()
    fm: dict[str, str] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return bool(self.collections or self.tags or self.fm)

    def within(self, scope: Sequence[str] | None) -> Filters:
        """Narrowed to the collections that a caller may see; without any of those, nothing matches."""
        if scope is None:
            return self
        seen = frozenset(scope) & self.collections if self.collections else frozenset(scope)
        return Filters(seen or frozenset([""]), self.tags, self.fm)

    def predicate(self, collection: str = "collection", tags: str = "tags", fm_terms: str = "fm_terms") -> Column:
        out = F.col(collection).isin(*sorted(self.collections)) if self.collections else F.lit(True)
        for tag in sorted(self.tags):
            out &= F.array_contains(tags, tag)
        return out & fm_filter(F.col(fm_terms), self.fm) if self.fm else out


# index


def postings(docs: DataFrame, fields: Sequence[str] = ("title", "content"), id: str = "id", tags: str | None = "tags") -> DataFrame:
    """field, term, id, tf. Tags are terms as a whole."""
    made = [docs.select(F.lit(f).alias("field"), F.col(id), F.explode(terms(F.coalesce(F.col(f), F.lit("")))).alias("term")) for f in fields]
    if tags:
        made.append(docs.select(F.lit(tags).alias("field"), F.col(id), F.explode(tags).alias("term")))
    return reduce(DataFrame.unionByName, made).groupBy("field", "term", id).agg(F.count("*").alias("tf"))


def field_lengths(posted: DataFrame, id: str = "id") -> DataFrame:
    return posted.groupBy("field", id).agg(F.sum("tf").alias("length"))


def document_frequencies(posted: DataFrame) -> DataFrame:
    return posted.groupBy("field", "term").agg(F.count("*").alias("df"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length"))


# lexical


def _idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _weight(tf: Column, length: Column, average: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * length / average))


def query_terms(query: str) -> list[str]:
    """The query's terms; upper-case operators are words like others. The rule is that of ``terms``."""
    import regex

    return list(dict.fromkeys(regex.findall(r"\p{Han}|(?:(?!\p{Han})[\p{L}\p{N}])+", query.lower())))


def scan_scores(docs: DataFrame, query: str, text: str = "text", id: str = "id", keep: Column | None = None) -> DataFrame:
    """``docs`` that have a term of the query, with score, over one text column and without an index. Texts without terms don't count in the statistics, as in an index.

    Two scans: one aggregates df and lengths to a single row, which every task of the other gets."""
    words = query_terms(query)
    if not words:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    held = terms(F.coalesce(F.col(text), F.lit("")))
    count = lambda word: F.size(F.filter("_t", lambda t: t == word))
    counted = docs.withColumn("_t", held).withColumn("_n", F.size("_t")).withColumns({f"_{i}": count(w) for i, w in enumerate(words)}).drop("_t")
    stats = counted.agg(F.count_if(F.col("_n") > 0).alias("_docs"), (F.sum("_n") / F.nullif(F.count_if(F.col("_n") > 0), F.lit(0))).alias("_avg"), *(F.count_if(F.col(f"_{i}") > 0).alias(f"_df{i}") for i in range(len(words))))
    rows = counted.where(reduce(Column.__or__, (F.col(f"_{i}") > 0 for i in range(len(words)))))
    rows = (rows.where(keep) if keep is not None else rows).join(F.broadcast(stats))
    score = reduce(Column.__add__, (F.when(F.col(f"_{i}") > 0, _idf(F.col(f"_df{i}"), F.col("_docs")) * _weight(F.col(f"_{i}"), F.col("_n"), F.col("_avg"))).otherwise(0.0) for i in range(len(words))))
    return rows.withColumn("score", score).select(*docs.columns, "score")


def weighted(hits: DataFrame, statistics: DataFrame, id: str = "id") -> DataFrame:
    """id and score of postings (field, term, id, tf, length) of a query's words, all of those words; statistics: field, docs, avg_length. Fields add up."""
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row per word and field at most
    return scores_of(hits, df, statistics, id)


def scores_of(hits: DataFrame, df: DataFrame, statistics: DataFrame, id: str = "id") -> DataFrame:
    """id and score. The parts of a document, one per word and field, are added in order of size, so that copies have equal scores to the last bit."""
    rows = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(statistics), "field")
    part = _idf(F.col("df"), F.col("docs")) * _weight(F.col("tf"), F.col("length"), F.col("avg_length"))
    parts = rows.groupBy(id).agg(F.array_sort(F.collect_list(part)).alias("_parts"))
    return parts.select(id, F.aggregate("_parts", F.lit(0.0), lambda s, x: s + x).alias("score"))


def top(scored: DataFrame, limit: int, offset: int = 0, id: str = "id") -> DataFrame:
    rows = scored.orderBy(F.desc("score"), id)
    return (rows.offset(offset) if offset else rows).limit(limit)


def top_with_more(scored: DataFrame, limit: int, offset: int = 0, id: str = "id") -> DataFrame:
    """A page of hits, each with whether another page follows: one row more than asked for is ranked."""
    rows = top(scored, limit + 1, offset, id)
    ranked = rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), id)))
    return ranked.withColumn("has_more", F.max("_r").over(Window.partitionBy()) > limit).where(F.col("_r") <= limit).drop("_r")


# vectors


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_scores(vectors: DataFrame, query: Sequence[float] | Column, id: str = "id", vector: str = "vector", keep: Column | None = None) -> DataFrame:
    """id and score (1 + cosine) / 2, the best chunk of each id. Vectors of another dimension are an error, those of length 0 have no score."""
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.where(keep) if keep is not None else vectors
    same = F.when(F.size(F.col(vector)) == F.size(q), True).otherwise(F.raise_error(F.lit("vector of another dimension")).cast("boolean"))
    norm = lambda v: F.sqrt(_dot(v, v))
    scored = rows.where(same).withColumn("score", (1 + _dot(F.col(vector), q) / F.nullif(norm(F.col(vector)) * norm(q), F.lit(0.0))) / 2).where("score IS NOT NULL")
    return scored.groupBy(id).agg(F.max("score").alias("score"))


def vector_scores_like(vectors: DataFrame, of: object, id: str = "id", vector: str = "vector", keep: Column | None = None) -> DataFrame:
    """The same for the vector of one id, which takes no part itself."""
    one = vectors.where(F.col(id) == F.lit(of)).select(F.col(vector).alias("_q")).limit(1)
    rows = (vectors.where(keep) if keep is not None else vectors).where(F.col(id) != F.lit(of)).join(F.broadcast(one))
    return vector_scores(rows, F.col("_q"), id, vector)


def superseded(scored: DataFrame, pending: DataFrame, id: str = "id") -> DataFrame:
    """``scored`` without ids that have newer, unindexed content; before any limit, so no overfetch is needed."""
    return scored.join(pending.select(id), id, "left_anti")


# fusion


def fused(rankings: Sequence[DataFrame], limit: int, depth: int, id: str = "id") -> DataFrame:
    """Reciprocal rank fusion of the first ``depth`` of each ranking."""
    ranked = [top(r.select(id, "score"), depth, id=id).select(id, (1.0 / (RRF + F.row_number().over(Window.orderBy(F.desc("score"), id)))).alias("part")) for r in rankings]
    return top(reduce(DataFrame.unionByName, ranked).groupBy(id).agg(F.sum("part").alias("score")), limit, id=id)


def overlaid(hits: DataFrame, pending: DataFrame, query: str, id: str = "id", text: str = "text") -> DataFrame:
    """Pending documents that have the query as a substring come first and supersede indexed hits of their ids."""
    fresh = pending.where(F.contains(F.lower(text), F.lit(query.lower()))).select(id, F.lit(1.7976931348623157e308).alias("score"))
    return superseded(hits.select(id, "score"), pending, id).unionByName(fresh)

"""The typed link graph: edges derived from text, links resolved, traversal, backlinks and repair."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import link_form, suffixes
from ..model import MAX_DEPTH, MAX_FANOUT, bounded, relation
from ..shared import shared_folder, written

EDGE_KEY = ["src", "dst", "rel"]
DRAWN = ("links", "refs", "author")  #: what edges are derived from


def _ends(documents: DataFrame, id: str = "id") -> DataFrame:
    """form and dst, one row per suffix of an id: the document of exactly that id, or else the least whose id ends in it."""
    ends = documents.select(F.col(id).alias("_to"), F.explode(suffixes(F.col(id))).alias("form"))
    return ends.groupBy("form").agg(F.min_by("_to", F.struct(F.col("_to") != F.col("form"), "_to")).alias("dst"))


def resolved(references: DataFrame, documents: DataFrame, target: str = "target", id: str = "id") -> DataFrame:
    """``references`` with dst: the document of exactly that id, or else the least whose id ends in it; null if none."""
    return references.withColumn("form", link_form(F.col(target))).join(_ends(documents, id), "form", "left")


def _drawn(parsed: DataFrame) -> DataFrame:
    """src, form, target, rel, ordinal, label, linked and embed: a row for each form that a note links to and for each target that it states.

    Links of one form are put together within their note, before anything is shuffled: the first by ordinal has the label, and one that embeds is enough."""
    formed = F.transform("links", lambda x: F.struct(link_form(x["target"]).alias("form"), (x["ordinal"] * 2).cast("int").alias("ordinal"), x["label"].cast("string").alias("label"), (~F.coalesce(x["embed"], F.lit(False))).alias("bare")))
    rows = parsed.select(F.col("id").alias("src"), "refs", "author", formed.alias("_formed"))
    rows = rows.select("src", "refs", "author", F.sort_array("_formed").alias("_plain"), F.sort_array(F.transform("_formed", lambda x: F.struct(x["form"].alias("form"), x["bare"].alias("bare")))).alias("_shown"))
    first = lambda c: F.filter(c, lambda x, i: (i == 0) | ~x["form"].eqNullSafe(F.get(F.col(c), i - 1)["form"]))
    none, no = F.lit(None).cast("string"), F.lit(False)

    def stated(rel: Column, target: Column, ordinal: Column) -> Column:
        """What is no link is its own end. A target that is embedded is one edge with links that embed it, so they have one key."""
        shown = rel.eqNullSafe(F.lit("embeds"))
        return F.struct(none.alias("form"), target.alias("target"), F.when(shown, "links-to").otherwise(rel).alias("rel"), F.when(~shown, ordinal.cast("int")).alias("ordinal"), none.alias("label"), (~shown).alias("linked"), shown.alias("embed"))

    linked = F.zip_with(first("_plain"), first("_shown"), lambda x, e: F.struct(x["form"].alias("form"), none.alias("target"), F.lit("links-to").alias("rel"), x["ordinal"].alias("ordinal"), x["label"].alias("label"), F.lit(True).alias("linked"), (~e["bare"]).alias("embed")))
    refs = F.transform("refs", lambda x: stated(x["rel"], x["target"], x["ordinal"] + 1_000_000))
    mentioned = F.when(F.coalesce(F.col("author"), F.lit("")) != "", F.array(stated(F.lit("mentions"), F.concat(F.lit("author/"), F.coalesce("author", F.lit(""))), F.lit(2_000_000))))
    out = F.concat(linked, refs, F.coalesce(mentioned, F.filter(refs, lambda x: no)))
    return rows.select("src", F.inline_outer(out)).where("form IS NOT NULL OR target IS NOT NULL")  # an outer generator, as in ``references``


def derived(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """The edges of parsed notes (id, links, refs, author): links, embeds, references and mentions. What resolves to nothing has no edge."""
    drawn = _drawn(parsed).withColumn("form", F.coalesce("form", "target"))  # so that what is stated is not dealt to one task
    found = drawn.join(_ends(documents), "form", "left").withColumn("dst", F.coalesce("target", "dst")).where("dst IS NOT NULL").drop("form", "target")
    # forms were put together before, so there is little to sum up ahead of the shuffle
    edges = found.repartition("src", "dst").groupBy("src", "dst", "rel").agg(F.min_by("label", "ordinal").alias("_label"), F.max("linked").alias("_linked"), F.max("embed").alias("_embed"))
    rels = edges.select("src", "dst", "rel", "_label", F.explode(F.array_compact(F.array(F.when(F.col("_linked"), 0), F.when(F.col("_embed"), 1)))).alias("_embed"))
    labelled = (F.col("_embed") == 0) & F.col("_label").isNotNull()
    return rels.select("src", "dst", F.when(F.col("_embed") == 0, F.col("rel")).otherwise("embeds").alias("rel"), F.when(labelled, F.create_map(F.lit("label"), "_label")).otherwise(F.create_map().cast("map<string,string>")).alias("props"))


def references(parsed: DataFrame) -> DataFrame:
    """src and target of every link of parsed notes (id, links), or of every target (id, targets). An outer generator: before an inner one Spark filters by size, and parses twice for that."""
    of, target = ("targets", "_link") if "targets" in parsed.columns else ("links", "_link.target")
    return parsed.select(F.col("id").alias("src"), F.posexplode_outer(of).alias("_n", "_link")).where("_n IS NOT NULL").select("src", F.col(target).alias("target"))


def unresolved(parsed: DataFrame, documents: DataFrame) -> DataFrame:
    """src and target of links that point to no document. Forms are told apart before they are joined, as one may be in every note."""
    links = written(references(parsed).withColumn("form", link_form(F.col("target"))))
    ends = documents.select(F.explode(suffixes(F.col("id"))).alias("form")).distinct()
    missing = written(links.select("form").distinct().join(ends, "form", "left_anti").select(F.col("form").alias("_form")))
    return links.join(missing, F.col("form").eqNullSafe(F.col("_form")), "left_semi").select("src", "target").distinct()


def neighbors_out(edges: DataFrame, node: Any, rel: str | None = None) -> DataFrame:
    return _of(edges, rel).where(F.col("src") == F.lit(node)).orderBy("rel", "dst")


def neighbors_in(edges: DataFrame, node: Any, rel: str | None = None) -> DataFrame:
    return _of(edges, rel).where(F.col("dst") == F.lit(node)).orderBy("rel", "src")


def _of(edges: DataFrame, rel: str | None) -> DataFrame:
    return edges if rel is None else edges.where(F.col("rel") == relation(rel))


def backlinks(edges: DataFrame, node: Any, rel: str | None = None) -> DataFrame:
    return neighbors_in(edges, node, rel).select("src").distinct()


def traverse(edges: DataFrame, starts: DataFrame | Sequence[Any], depth: int, rel: str | None = "links-to", fanout: int | None = MAX_FANOUT, visible: DataFrame | None = None) -> DataFrame:
    """id, depth and path of first discovery, breadth first along out-edges. The start itself is found again only on a cycle.

    Ordered by (depth, path) the rows are in the order of discovery, where a node's edges are followed in order of
    their ends; ``fanout`` of them at most, all with None. ``visible``: ids that may be returned. Every level is written, so each
    costs one scan of the edges and two joins, however deep it is; a level without new nodes is the last."""
    bounded("depth", depth, 0, MAX_DEPTH)
    spark = edges.sparkSession
    steps = _of(edges, rel).select("src", "dst")
    kind = steps.schema["dst"].dataType
    frontier = starts.select("id") if isinstance(starts, DataFrame) else spark.range(1).select(F.explode(F.array(*(F.lit(s).cast(kind) for s in starts))).alias("id"))
    frontier = frontier.distinct().select("id", F.array("id").alias("path"))
    folder, found = shared_folder(spark), spark.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("depth", T.IntegerType()), T.StructField("path", T.ArrayType(kind))]))
    schema = found.schema
    for level in range(1, depth + 1):
        near = steps.join(frontier.select(F.col("id").alias("src"), "path"), "src").distinct()
        if fanout is not None:
            near = near.withColumn("_n", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).where(F.col("_n") <= fanout)
        first = near.groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        fresh = first if level == 1 else first.join(found.select("id"), "id", "left_anti")
        written(fresh.select("id", F.lit(level).alias("depth"), "path"), f"{folder}/{level}")
        found = spark.read.schema(schema).parquet(*(f"{folder}/{k}" for k in range(1, level + 1)))
        frontier = spark.read.schema(schema).parquet(f"{folder}/{level}").select("id", "path")
        if level < depth and frontier.isEmpty():
            break
    return found if visible is None else found.join(visible.select("id"), "id", "left_semi")


def replaced(edges: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """``edges`` with the out-edges of ``sources`` (id) replaced by ``new``, whose first of a key counts."""
    return _kept(edges, sources).unionByName(new.select(*edges.columns).dropDuplicates(EDGE_KEY))


def _kept(edges: DataFrame, sources: DataFrame) -> DataFrame:
    return edges.join(sources.select(F.col("id").alias("src")), "src", "left_anti").select(*edges.columns)


def upserted(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.join(new.select(*EDGE_KEY), EDGE_KEY, "left_anti").select(*edges.columns).unionByName(new.select(*edges.columns).dropDuplicates(EDGE_KEY))


def without(edges: DataFrame, nodes: DataFrame, end: str = "src") -> DataFrame:
    """``edges`` without those that leave (src) or reach (dst) ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").select(*edges.columns)


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """id of the sources whose sets of (dst, rel) differ, so that unchanged ones are not rewritten."""
    sets = lambda e, c: e.groupBy("src").agg(F.sort_array(F.collect_set(F.struct("dst", "rel"))).alias(c))
    return sets(old, "a").join(sets(new, "b"), "src", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("src").alias("id"))


def repair_candidates(references: DataFrame, changed: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """id of the documents that a link of which may resolve otherwise since ``changed`` (id) came or went; queued ones are left to the queue."""
    ends = changed.select(F.explode(suffixes(F.col("id"))).alias("form")).distinct()
    out = references.select(F.col("src").alias("id"), link_form(F.col("target")).alias("form")).join(ends, "form", "left_semi").select("id").distinct()
    return out if queued is None else out.join(queued.select("id"), "id", "left_anti")


def repaired(edges: DataFrame, parsed: DataFrame, documents: DataFrame, changed: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """``edges`` after ``changed`` (id) came or went: the out-edges of the parsed notes whose links may resolve otherwise are derived anew."""
    sources = written(repair_candidates(references(parsed), changed, queued))
    return _kept(edges, sources).unionByName(derived(parsed.join(sources, "id", "left_semi"), documents).select(*edges.columns))  # derived edges come once


def masked(answer: DataFrame, pending: DataFrame, deleted: DataFrame, start: Any) -> DataFrame:
    """An answer without tombstones; none at all while its start is pending."""
    return answer.join(deleted.select("id"), "id", "left_anti").join(F.broadcast(pending.where(F.col("id") == F.lit(start)).agg(F.count("*").alias("_p"))).where("_p = 0")).drop("_p")


def edge(src: Column, rel: str, dst: Column) -> list[Column]:
    """The columns of a bare edge."""
    return [src.alias("src"), dst.alias("dst"), F.lit(relation(rel)).alias("rel")]

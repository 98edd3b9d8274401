"""The given tables in the corpus model: documents, edges, history, outbox and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frontmatter import text_term


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose: a collection per language, the source as tag, and n_chars as front matter."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id"), F.lit(".md"))).alias("path"), F.array("source").alias("tags"), F.array(F.concat(F.lit("n_chars=n:"), "n_chars"), F.concat(F.lit("source="), text_term(F.col("source")))).alias("fm_terms"), "text", F.lit(False).alias("deleted"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: a collection per priority, finished ones as tombstones."""
    o = table(spark, sf_dir, "orders")
    content = F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("collection"), F.concat(F.lit("customer_"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.lit(".md")).alias("path"), content.alias("content"), F.sha2(content, 256).alias("content_hash"), F.concat(F.lit("rev-"), "o_orderkey").alias("revision"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), (F.col("o_orderstatus") == "F").alias("deleted"))


def links(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Foreign keys as edges: src, dst, rel; some come twice unless ``distinct``."""

    def of(name: str, src: str, src_key: str, dst: str, dst_key: str, rel: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(src + "/"), src_key).alias("src"), F.concat(F.lit(dst + "/"), dst_key).alias("dst"), F.lit(rel).alias("rel"))

    parts = [
        of("customer", "customer", "c_custkey", "nation", "c_nationkey", "links-to"),
        of("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "links-to"),
        of("nation", "nation", "n_nationkey", "region", "n_regionkey", "links-to"),
        of("orders", "orders", "o_orderkey", "customer", "o_custkey", "references"),
        of("lineitem", "orders", "l_orderkey", "part", "l_partkey", "embeds"),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])
    return rows.distinct() if distinct else rows


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as revisions: a document each, a revision per turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), F.format_string("rev-%06d", "turn").alias("revision"), F.col("role").alias("author"), F.col("turn").alias("created_at"), F.col("text").alias("content"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an outbox: errors are deletions, ``k`` of the properties tells attempts."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), F.col("event_type").alias("collection"), F.when(F.col("event_type") == "error", "DELETE").otherwise("UPSERT").alias("kind"), F.sha2(F.col("props"), 256).alias("content_hash"), F.col("ts").alias("created_at"), F.when(k < 80, 0).otherwise(k - 79).alias("attempts"), (k >= 95).alias("dead_lettered"), F.col("value"), F.col("props"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings: one chunk each, the label as collection."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("collection"), F.col("embedding").alias("vector"))

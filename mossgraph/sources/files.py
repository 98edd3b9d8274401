"""Directories of notes as DataFrames. Bad names are reported as rows, not raised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sanitized, sha256
from ..model import DEFAULT_COLLECTION, Unsupported

#: Folders that tools keep their own files in.
BOOKKEEPING = (".pijul", ".obsidian", ".trash")
TOKEN_WINDOW = 64 << 10


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path (relative), size, modified and bytes of every file below ``folder``.

    Spark's readers pass over files of length 0, so those come from a listing on the driver."""
    root = F.lit(folder.rstrip("/") + "/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if empty := _empty_files(spark, folder):
        found = found.unionByName(spark.createDataFrame(empty, "path string, modified long").select("path", F.timestamp_millis("modified").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    relative = F.substring_index(F.col("path"), root, -1) if "://" in folder else F.regexp_replace("path", "^(file:)?/*" + _quoted(folder.strip("/")) + "/", "")
    return found.select(relative.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("content").alias("bytes"))


def _empty_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """Path and modification time of the files of length 0, but for those that Spark's readers hide."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed, out = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            out.append((status.getPath().toString(), status.getModificationTime()))
    return out


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def hidden(path: Column) -> Column:
    """Whether a segment begins with a dot; that takes in all bookkeeping folders."""
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))


def valid_name(path: Column) -> Column:
    bare = F.regexp_replace(path, r"(?i)\.md$", "")
    parts = F.split(bare, "/")
    return (F.trim(bare) == bare) & ~F.contains(bare, F.lit("\\")) & ~F.rlike(bare, F.lit(r"[\p{Cntrl}]")) & ~F.rlike(bare, F.lit(r"(?i)\.md$")) & F.forall(parts, lambda p: ~p.isin("", ".", ".."))


def notes(spark: SparkSession, folder: str, collection: str = DEFAULT_COLLECTION) -> tuple[DataFrame, DataFrame]:
    """The documents of a vault, and path and reason of each file whose name can be no document."""
    found = files(spark, folder).where(F.rlike("path", F.lit(r"(?i)\.md$")) & ~F.exists(F.split("path", "/"), lambda p: p.isin(*BOOKKEEPING)))
    named = found.withColumn("ok", valid_name(F.col("path")))
    content = F.col("bytes").cast("string")
    documents = named.where("ok").select(F.regexp_replace("path", r"(?i)\.md$", "").alias("id"), F.lit(collection).alias("collection"), "path", content.alias("content"), sha256(content).alias("content_hash"), F.col("modified").alias("updated_at"), change_token(F.col("size"), F.col("bytes")).alias("change_token"), F.lit(False).alias("deleted"))
    return documents, named.where(~F.col("ok")).select("path", F.lit("bad name").alias("reason"))


def change_token(size: Column, data: Column, window: int = TOKEN_WINDOW) -> Column:
    """Size and a hash: of the whole of a small file, of head and tail of a large one."""
    short = size <= 2 * window
    held = F.when(short, data).otherwise(F.concat(F.substring(data, 1, window), F.substring(data, -window, window)))
    return F.concat(size.cast("string"), F.lit(":"), F.sha2(held, 256))


class PlainDirectory:
    """A read-only source: reads skip dot segments, and every write raises."""

    def __init__(self, spark: SparkSession, folder: str, collection: str = DEFAULT_COLLECTION):
        self.spark, self.folder, self.collection = spark, folder, collection

    def documents(self) -> DataFrame:
        return notes(self.spark, self.folder, self.collection)[0].where(~hidden(F.col("path")))

    def __getattr__(self, name: str):
        if name in ("upsert", "delete", "restore", "rename", "put_blob", "replace_edges"):
            raise Unsupported(f"{name}: this source is read-only")
        raise AttributeError(name)


def import_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """path, document id and content of what an import takes: no dot segments, names made valid."""
    return files(spark, folder).where(~hidden(F.col("path")) & F.rlike("path", F.lit(r"(?i)\.md$"))).select("path", sanitized(F.col("path")).alias("id"), F.col("bytes").cast("string").alias("content"))


def event_document(path: Column, root: str, vault: str) -> Column:
    """The document that a file event is about: of absolute, relative and vault-prefixed paths that end in .md."""
    relative = F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).when(F.startswith(path, F.lit(vault + "/")), F.substring(path, len(vault) + 2, 1 << 20)).otherwise(path)
    return F.when(F.endswith(relative, F.lit(".md")) & ~F.startswith(relative, F.lit("/")), F.regexp_replace(relative, r"\.md$", ""))

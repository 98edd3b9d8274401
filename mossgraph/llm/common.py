"""Shared folder, written tables and word rules of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_folder

#: ASCII white space; words are the runs of anything else. ``bytes.split()`` splits by the same six.
WHITE = " \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A new folder below ``spark.checkpoint.dir``.
shared_dir = shared_folder


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and lost executors cost no recomputation."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fewer(df: DataFrame) -> DataFrame:
    """``df`` in a quarter as many parts as a shuffle has, one for each core at least: for narrow tables, where most of a task is its start and its file."""
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


class Scratch:
    """Tables in a shared folder that goes when the block ends; what leaves the block must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_dir(spark), 0

    def written(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return written(df, f"{self.folder}/{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Batches on disk in the order in which each rank takes them, with an index of the files."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from reasonloom.sources.paths import glob_free, relative_path, scanned_path

INDEX = "_index"  # the underscore keeps Spark's readers from taking it for data


def write_ranks(batches: DataFrame, folder: str, files: int | None = None) -> DataFrame:
    """Write batches (shard, batch_id, ...) below `folder`, and return the index.

    They are dealt to tasks by ranges of (shard, batch_id), so a file holds neighbouring batches of
    one shard in their order, and every shard has about its share of the `files`. Repeated batch
    ids stay in the same file. The index, a row per file, is (shard, file, first_batch, last_batch,
    n_batches); it stands in `_index` below the folder.
    """
    spark = batches.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = batches.repartitionByRange(n, "shard", "batch_id")
    ordered = ranged.sortWithinPartitions("shard", "batch_id")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(folder)
    written = spark.read.schema(batches.schema).parquet(folder)
    named = written.select("shard", "batch_id", relative_path(scanned_path(), folder).alias("file"))
    index = named.groupBy("shard", "file").agg(
        F.min("batch_id").alias("first_batch"),
        F.max("batch_id").alias("last_batch"),
        F.count("*").alias("n_batches"),
    )
    index.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{INDEX}")
    return spark.read.parquet(f"{folder}/{INDEX}")


def files_of_rank(spark: SparkSession, folder: str, shard: int, start: int = 0) -> list[Row]:
    """The index rows of a shard's files from batch `start` on, in order: those of one rank alone."""
    index = spark.read.parquet(f"{folder}/{INDEX}")
    mine = index.filter((F.col("shard") == shard) & (F.col("last_batch") >= start))
    return mine.sort("first_batch").collect()


def _file(spark: SparkSession, folder: str, shard: int, name: str) -> DataFrame:
    rows = spark.read.parquet(glob_free(f"{folder.rstrip('/')}/{name}"))
    return rows.withColumn("shard", F.lit(shard).cast("long"))


def read_rank(spark: SparkSession, folder: str, shard: int, start: int = 0) -> DataFrame:
    """A shard's batches from `start` on; only files that hold one are read, in any order."""
    names = [r["file"] for r in files_of_rank(spark, folder, shard, start)]
    if not names:
        return spark.read.parquet(folder).limit(0)
    paths = [glob_free(f"{folder.rstrip('/')}/{name}") for name in names]
    rows = spark.read.parquet(*paths).withColumn("shard", F.lit(shard).cast("long"))
    return rows.filter(F.col("batch_id") >= start)


def iterate_rank(spark: SparkSession, folder: str, shard: int, start: int = 0) -> Iterator[Row]:
    """A shard's batches in order from `start` on, file by file: the stream that a rank consumes.

    To resume, give the batch after the last one taken. One file's batches are held at a time.
    """
    for row in files_of_rank(spark, folder, shard, start):
        some = _file(spark, folder, shard, row["file"]).filter(F.col("batch_id") >= start)
        yield from some.coalesce(1).sortWithinPartitions("batch_id").toLocalIterator()

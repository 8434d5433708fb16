"""Whole files of a corpus copied by tasks, byte for byte, with a manifest."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.sources.files import sample_files
from reasonloom.sources.paths import list_files, plain_path, relative_path
from reasonloom.sources.stores import store_of

CHUNK = 8 << 20
MANIFEST = "_manifest"  # the underscore keeps Spark's readers from taking it for data
COPIED = "source_file string, path string, n_bytes long, md5 string, error string"


def copy_file(source: str, target: str) -> tuple[int, str]:
    """Copy one file in chunks; the bytes and their md5. The target appears whole or not at all."""
    store, at = store_of(source)
    out_store, out_at = store_of(target)
    folder, _, name = out_at.rpartition("/")
    out_store.create_dir(folder, recursive=True)
    part = f"{folder}/_{uuid.uuid4().hex}.part"
    digest, n_bytes = hashlib.md5(), 0
    try:
        with store.open_input_stream(at) as data, out_store.open_output_stream(part) as out:
            while chunk := data.read(CHUNK):
                out.write(chunk)
                digest.update(chunk)
                n_bytes += len(chunk)
        out_store.move(part, f"{folder}/{name}")
    except BaseException:
        if out_store.get_file_info(part).is_file:
            out_store.delete_file(part)
        raise
    return n_bytes, digest.hexdigest()


def copy_files(chosen: DataFrame, target: str, skip_failing: bool = False) -> DataFrame:
    """Copy the files of `path` to `source_file` below `target`; the manifest, a row per file.

    Files are dealt to tasks by name and copied in chunks; a repeated task writes the same file
    once more. A file that cannot be copied, or whose size is not the one listed in `length`, is an
    error in the manifest and does not stop the others; unless `skip_failing`, it is raised when
    all others are done. The manifest stands in `_manifest` below the target.
    """
    spark = chosen.sparkSession

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = {"source_file": row["source_file"], "path": row["path"]}
                try:
                    n, md5 = copy_file(row["path"], f"{target}/{row['source_file']}")
                    made |= {"n_bytes": n, "md5": md5}
                    if n != row["length"]:
                        made["error"] = f"{row['length']} bytes were listed, {n} were read"
                except Exception as error:  # of any kind: it is reported with the file
                    made["error"] = f"{type(error).__name__}: {error}"
                yield pa.RecordBatch.from_pylist([made], schema=schema)

    names = [field.split(" ") for field in COPIED.split(", ")]
    schema = pa.schema([(c, pa.int64() if kind == "long" else pa.string()) for c, kind in names])
    files = chosen.select("source_file", "path", "length")
    cores = spark.sparkContext.defaultParallelism
    made = files.repartition(max(cores, files.count()), "source_file").mapInArrow(copy, COPIED)
    made.write.mode("overwrite").parquet(f"{target}/{MANIFEST}")
    manifest = spark.read.parquet(f"{target}/{MANIFEST}")
    failed = manifest.filter("error IS NOT NULL")
    if not skip_failing and (first := failed.first()):
        raise OSError(f"{failed.count()} files not copied, first {first['path']}: {first['error']}")
    return manifest


def sample_copies(
    spark: SparkSession,
    root: str,
    target: str,
    ratio: float | None = None,
    count: int | None = None,
    seed: int = 42,
    skip_failing: bool = False,
    recursive: bool = False,
) -> DataFrame:
    """Copy a seeded sample of the Parquet files of a folder: the same files as `sample_files` takes."""
    path = plain_path(F.col("path"))
    listed = list_files(spark, root, recursive=recursive).select(
        relative_path(path, root).alias("source_file"), path.alias("path"), "length"
    )
    return copy_files(sample_files(listed, ratio, count, seed), target, skip_failing)

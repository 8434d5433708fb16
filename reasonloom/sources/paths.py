"""Paths as data: listings, include / exclude selection, manifests."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.functions.text import split_path

MANIFEST_SCHEMA = "siblings array<struct<rfilename: string>>"


def is_directory(spark: SparkSession, path: str) -> bool:
    """True for a folder on any file system Spark can reach."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def list_files(
    spark: SparkSession, root: str, pattern: str = "*.parquet", recursive: bool = False
) -> DataFrame:
    """(path, length) of the files under a folder. No file content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(root).select("path", "length")


def plain_path(path: Column) -> Column:
    """One spelling for local paths: listings say file:/x, scans say file:///x."""
    return F.regexp_replace(path, "^file:/+", "/")


def scanned_path() -> Column:
    """Path of the file a scanned row comes from, spelled as in a listing.

    Scans escape special characters as URLs do, except the plus sign.
    """
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return plain_path(F.when(F.contains(path, F.lit("%")), decoded).otherwise(path))


def relative_path(path: Column, root: str) -> Column:
    """Path below `root`; the whole path if it lies elsewhere."""
    base = re.sub("^file:/+", "/", root.rstrip("/")) + "/"
    below = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(base)), below).otherwise(path)


def glob_free(path: str) -> str:
    """A path as a reader takes it literally: characters of patterns are escaped."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def list_source_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(source_file) of a folder's top level, spelled as `with_source_file` does."""
    listed = list_files(spark, root, pattern)
    return listed.select(relative_path(plain_path(F.col("path")), root).alias("source_file"))


def glob_regex(patterns: Sequence[str]) -> str:
    """Dots are literal, `*` matches anything, patterns are alternatives.

    The match is not anchored; other regex characters keep their meaning.
    """
    return "|".join(p.replace(".", "\\.").replace("*", ".*") for p in patterns)


def select_paths(
    df: DataFrame, col: str, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Keep rows whose path is not null, matches `include` and not `exclude`."""
    keep = F.col(col).isNotNull()
    if include:
        keep = keep & F.col(col).rlike(glob_regex(include))
    if exclude:
        keep = keep & ~F.col(col).rlike(glob_regex(exclude))
    return df.filter(keep)


def manifest_files(
    df: DataFrame,
    col: str = "manifest",
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """One row per file of a JSON manifest, with `path`, its folder `dir` and its `name`."""
    others = [c for c in df.columns if c != col]
    listed = df.select(
        *others, F.explode(F.from_json(col, MANIFEST_SCHEMA)["siblings"]["rfilename"]).alias("path")
    )
    folder, name = split_path("path")
    return select_paths(listed, "path", include, exclude).select(
        *others, "path", folder.alias("dir"), name.alias("name")
    )

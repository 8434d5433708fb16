"""Corpus at file level: sampling, offsets, global row index, profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.operators.ordering import (
    NULL_KEY,
    hash_position,
    order_position,
    running_total,
    seeded_hash,
)
from reasonloom.session import ensure_checkpoint_dir
from reasonloom.sources.paths import glob_free, scanned_path
from reasonloom.sources.readers import read_parquet_dir, with_source_file

CHUNK_BITS = 20


def sample_size(n_files: int, ratio: float | None, count: int | None) -> int:
    """How many files to take; `count` overrides `ratio`."""
    if count is not None:
        if count <= 0:
            raise ValueError("count must be positive")
        return min(count, n_files)
    if ratio is None:
        raise ValueError("give a ratio or a count")
    if not 0 < ratio <= 1:
        raise ValueError("ratio must be above 0 and at most 1")
    return min(n_files, max(1, int(n_files * ratio)))


def sample_files(
    df: DataFrame,
    ratio: float | None = None,
    count: int | None = None,
    seed: int = 42,
    col: str = "source_file",
    listing: DataFrame | None = None,
) -> DataFrame:
    """All rows of a seeded sample of files.

    The files are those of `listing`, with a column `col`, or else those that
    the rows name. A scan whose `col` is its file path reads the chosen files only.

    Files are ranked by md5(seed:file). Only the last one taken is looked up;
    every row then decides for itself whether its file ranks no later. So there
    is no join, and it does not matter how many rows one file has.
    """
    sample_size(1, ratio, count)  # the arguments are checked before any job runs
    ensure_checkpoint_dir(df.sparkSession)
    files = (df if listing is None else listing).select(col).distinct().checkpoint()
    n_files = files.count()
    if n_files == 0:
        return df
    prefix = f"{seed}:"
    last = sample_size(n_files, ratio, count) - 1
    edge = hash_position(files, col, prefix).filter(F.col("pos") == last).first()[col]
    edge_hash = seeded_hash(prefix, F.lit(edge).cast("string"))
    edge_name = F.lit(NULL_KEY if edge is None else str(edge))
    row_hash, row_name = seeded_hash(prefix, col), F.coalesce(F.col(col).cast("string"), F.lit(NULL_KEY))
    return df.filter((row_hash < edge_hash) | ((row_hash == edge_hash) & (row_name <= edge_name)))


def _file_order(col: str, seed: int | None) -> list[Column]:
    """By name, or in the shuffled order of the seed."""
    return [F.col(col)] if seed is None else [seeded_hash(f"{seed}:", col), F.col(col)]


def file_offsets(df: DataFrame, col: str = "source_file", seed: int | None = None) -> DataFrame:
    """(file, n_rows, row_offset): the number of rows in all earlier files."""
    sizes = df.groupBy(col).agg(F.count("*").alias("n_rows"))
    return running_total(sizes, _file_order(col, seed), "n_rows", "row_offset")


def with_global_index(
    df: DataFrame,
    col: str = "source_file",
    row: str = "row_in_file",
    seed: int | None = None,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Add `global_idx` to rows that know their 0-based number in their file.

    `offsets` are those of the whole source (`file_offsets`), so that rows of a
    filtered table keep their numbers in it. Without them, a file counts as long
    as its highest row number tells. Rows are joined by file and range of 2^20
    row numbers, so a large file is many keys; a null file is a file as well.
    """
    if offsets is None:
        sizes = df.groupBy(col).agg((F.max(row) + 1).alias("n_rows"))
        offsets = running_total(sizes, _file_order(col, seed), "n_rows", "row_offset")
    last = F.greatest((F.col("n_rows") - 1).cast("long"), F.lit(0))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(last, CHUNK_BITS)))
    starts = offsets.select(F.col(col).alias("_file"), "row_offset", chunk.alias("_chunk"))
    same = df[col].eqNullSafe(F.col("_file")) & (
        F.shiftright(df[row].cast("long"), CHUNK_BITS) == F.col("_chunk")
    )
    placed = df.join(starts, same).withColumn("global_idx", F.col("row_offset") + F.col(row))
    return placed.drop("_file", "_chunk", "row_offset")


def rows_at(spark: SparkSession, root: str, indexes: list[int]) -> DataFrame:
    """The rows of a Parquet folder with the given global indexes, with `global_idx`.

    Files are numbered by name. Their sizes come from the footers; then the files that hold a
    wanted row are read whole. `footers.lookup` reads only the row groups that hold one.
    """
    rows = with_source_file(read_parquet_dir(spark, root), root)
    path = scanned_path()
    sizes = rows.select(path.alias("path"), "source_file").groupBy("path", "source_file").agg(
        F.count("*").alias("n_rows")
    )
    offsets = running_total(sizes, [F.col("source_file")], "n_rows", "row_offset")
    first, after = F.col("row_offset"), F.col("row_offset") + F.col("n_rows")
    listed = F.array(*map(F.lit, sorted(set(indexes)))).cast("array<bigint>")
    inside = F.filter(listed, lambda i: (i >= first) & (i < after))
    # a row per file that holds a wanted row: at most as many as the caller listed
    places = offsets.withColumn("wanted", inside).filter(F.size("wanted") > 0).collect()
    missing = set(indexes).difference(*(p["wanted"] for p in places)) if places else set(indexes)
    if missing:
        raise IndexError(f"no row {sorted(missing)}")
    found = None
    for place in sorted(places, key=lambda p: p["row_offset"]):
        numbers = [i - place["row_offset"] for i in place["wanted"]]
        one = with_source_file(spark.read.parquet(glob_free(place["path"])), root)
        one = one.filter(F.col("row_in_file").isin(numbers))
        one = one.withColumn("global_idx", F.col("row_in_file") + place["row_offset"])
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    if found is None:
        return rows.withColumn("global_idx", F.lit(None).cast("long")).limit(0)
    return found


def rank_rows(
    df: DataFrame, col: str = "source_file", key: str = "example_id", seed: int | None = None
) -> DataFrame:
    """(file, key, global_idx) for rows ordered inside their file by a unique key."""
    return order_position(
        df.select(col, key), [*_file_order(col, seed), F.col(key)], "global_idx"
    )


def row_at(indexed: DataFrame, idx: int) -> DataFrame:
    """The row with a given `global_idx`."""
    row = indexed.filter(F.col("global_idx") == idx)
    if idx < 0 or row.isEmpty():
        raise IndexError(f"no row {idx}")
    return row


def profile(df: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """(column_name, n_rows, n_null) in one pass; a missing required column has no n_null."""
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in df.columns])
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"`{c}`")).alias("n_null"),
        )
        for c in df.columns
    ] + [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("n_rows"),
            F.lit(None).cast("long").alias("n_null"),
        )
        for c in required
        if c not in df.columns
    ]
    return counts.select(F.inline(F.array(*entries)))


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)

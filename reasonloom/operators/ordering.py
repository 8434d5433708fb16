"""Positions in a global order, without sorting the data in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonloom.session import ensure_checkpoint_dir

# Rows are grouped by the first digits of their hash: at most 16 ** 4 groups of
# about the same size, however large the data.
HASH_DIGITS = 4
ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
NULL_KEY = "\x00"  # what a null key is hashed as; no name or number is this text


def seeded_hash(prefix: str, key: Column | str) -> Column:
    """Never null, so a row with a null key keeps its place in the order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(prefix), F.coalesce(key.cast("string"), F.lit(NULL_KEY))))


def _starts(sizes: DataFrame, group: str, size: str) -> DataFrame:
    """First position of every group. The input has a bounded number of rows."""
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(group, F.coalesce(F.sum(size).over(before), F.lit(0)).alias("_start"))


def hash_position(df: DataFrame, key: str, prefix: str, out: str = "pos") -> DataFrame:
    """Add the 0-based position in the order of (md5(prefix + key), key).

    The groups are ranges of the hash, so counting them, adding up the counts
    and numbering the rows inside each group gives the global position. `key`
    must be unique; a null key counts as one and comes first among equal hashes. The input is read twice, once for the key column only.
    """
    digits = F.substring(seeded_hash(prefix, key), 1, HASH_DIGITS)
    sizes = df.groupBy(digits.alias("_bucket")).agg(F.count("*").alias("_size"))
    starts = F.broadcast(_starts(sizes, "_bucket", "_size"))
    keyed = df.withColumn("_hash", seeded_hash(prefix, key)).withColumn(
        "_bucket", F.substring("_hash", 1, HASH_DIGITS)
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", key)) - 1
    return (
        keyed.join(starts, "_bucket")
        .withColumn(out, F.col("_start") + inside)
        .drop("_bucket", "_hash", "_start")
    )


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Range-partition, sort and number the rows; written once, so the numbers stay."""
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_row", ROW_BITS))
        .checkpoint()
    )


def order_position(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Add the 0-based position in a global order; `order` must leave no ties.

    Pass key columns only: the rows are written to the checkpoint folder.
    """
    rows = _numbered(df, order)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    in_part = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        rows.join(F.broadcast(_starts(sizes, "_part", "_size")), "_part")
        .withColumn(out, F.col("_start") + in_part)
        .drop("_part", "_row", "_start")
    )


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Add the sum of `value` over all earlier rows of a global order."""
    rows = _numbered(df, order)
    sizes = rows.groupBy("_part").agg(F.sum(value).alias("_size"))
    before = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.join(F.broadcast(_starts(sizes, "_part", "_size")), "_part")
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(before), F.lit(0)))
        .drop("_part", "_row", "_start")
    )


def shuffle_rows(
    df: DataFrame, seed: int, epoch: int = 0, key: str = "example_id", out: str = "pos"
) -> DataFrame:
    """Reproducible shuffle: position in the order of md5(seed:epoch:key)."""
    return hash_position(df, key, f"{seed}:{epoch}:", out)


def shuffle_files(files: DataFrame, seed: int, col: str = "source_file") -> DataFrame:
    """Reproducible file order, one row per file."""
    return hash_position(files.select(col).distinct(), col, f"{seed}:", "file_pos")

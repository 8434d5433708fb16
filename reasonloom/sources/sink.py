"""One output folder per source file."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_filtered(
    df: DataFrame, out: str, col: str = "source_file", gather: bool = False
) -> None:
    """Write each source file's rows to its own folder; no rows, no folder.

    Rows that come straight from a scan lie together by file, so nothing is
    shuffled. After a shuffle of their own, `gather` avoids many small files: the
    rebalance hint brings a file's rows together, and the adaptive planner
    splits a large file over several tasks.
    """
    rows = df.hint("rebalance", col) if gather else df
    rows.write.mode("overwrite").partitionBy(col).parquet(out)

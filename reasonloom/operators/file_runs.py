"""Curation file by file: one that fails does not stop the others, and a second run goes on.

Files are worked on in groups, a Spark job each, so the fixed cost of a job is shared. A group that
fails is cut into parts until the failing files stand alone; the others are done. What became of a
file is a row of the log below the target, and a later run takes up only files that are not done,
or were changed since.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.operators.curate import CurateConfig, curate
from reasonloom.sources.paths import plain_path, relative_path
from reasonloom.sources.readers import ABSENT, only_below, read_differing

LOG = "_log"  # the underscore keeps Spark's readers from taking it for data
LOG_SCHEMA = "source_file string, length long, modified timestamp, status string, n_rows long, error string"
File = tuple[str, str, int, object]  # path, source_file, length, time of the last change


def _entries(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.parquet(f"{out}/{LOG}")
    except PySparkException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{LOG_SCHEMA}, run long")


def _next_run(spark: SparkSession, out: str) -> int:
    last = _entries(spark, out).agg(F.max("run")).first()[0]
    return 0 if last is None else last + 1


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """The last entry of each file: source_file, length, modified, status, n_rows, error."""
    names = ["length", "modified", "status", "n_rows", "error"]
    entries = _entries(spark, out).groupBy("source_file")
    last = entries.agg(F.max_by(F.struct(*names), "run").alias("e"))
    return last.select("source_file", *(f"e.{c}" for c in names))


def pending_files(spark: SparkSession, root: str, out: str) -> DataFrame:
    """path, source_file, length, modified of the files that are not done, or not as they are now."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    listed = reader.option("recursiveFileLookup", only_below(spark, root)).load(root)
    path = plain_path(F.col("path"))
    listed = listed.select(
        path.alias("path"),
        relative_path(path, root).alias("source_file"),
        "length",
        F.col("modificationTime").alias("modified"),
    )
    done = read_log(spark, out).filter("status = 'done'").select("source_file", "length", "modified")
    return listed.join(done, ["source_file", "length", "modified"], "left_anti").select(
        "path", "source_file", "length", "modified"
    )


def _reason(error: Exception) -> str:
    lines = [x for x in str(error).splitlines() if x.strip() and not x.lstrip().startswith("at ")]
    return f"{type(error).__name__}: {' '.join(lines)[:500]}"


def curate_each(
    spark: SparkSession,
    root: str,
    out: str,
    cfg: CurateConfig = CurateConfig(),
    group: int = 10_000,
    parts: int = 16,
) -> DataFrame:
    """Curate every pending file below `root` into its folder below `out`; the log, a row per file.

    A folder appears when its whole group is written, and replaces that of an earlier run; a file
    without kept rows has none. With f failing files of n, about f * parts * log(n, parts) further
    jobs run. The names of a group's files pass through the driver, one group at a time.
    """
    files = pending_files(spark, root, out).sort("source_file")
    run = _next_run(spark, out)
    some: list[File] = []
    for row in files.toLocalIterator():
        some.append(tuple(row))
        if len(some) == group:
            _work(spark, root, out, cfg, some, parts, run)
            some = []
    if some:
        _work(spark, root, out, cfg, some, parts, run)
    return read_log(spark, out)


def _work(
    spark: SparkSession, root: str, out: str, cfg: CurateConfig, files: list[File], parts: int, run: int
) -> None:
    try:
        counts = _curate_group(spark, root, out, cfg, [f[0] for f in files])
    except Exception as error:  # of any kind: it is logged with the file
        if len(files) == 1:
            _note(spark, out, run, files, "failed", {}, _reason(error))
            return
        step = -(-len(files) // parts)
        for start in range(0, len(files), step):
            _work(spark, root, out, cfg, files[start : start + step], parts, run)
    else:
        _note(spark, out, run, files, "done", counts, None)


def _curate_group(
    spark: SparkSession, root: str, out: str, cfg: CurateConfig, paths: list[str]
) -> dict[str, int]:
    """Write the kept rows of these files; how many of each."""
    rows = read_differing(spark, root, only_below(spark, root), only=paths)
    kept = curate(rows, cfg).drop(ABSENT)
    writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("source_file").parquet(out)
    written = spark.read.parquet(out) if not kept.isEmpty() else kept
    names = kept.select("source_file").distinct()
    counted = written.join(names, "source_file", "left_semi").groupBy("source_file").count()
    return {r["source_file"]: r["count"] for r in counted.collect()}


def _note(
    spark: SparkSession,
    out: str,
    run: int,
    files: list[File],
    status: str,
    counts: dict[str, int],
    error: str | None,
) -> None:
    rows = [
        (name, length, modified, status, counts.get(name, 0) if status == "done" else None, error, run)
        for _, name, length, modified in files
    ]
    entries = spark.createDataFrame(rows, f"{LOG_SCHEMA}, run long")
    entries.coalesce(1).write.mode("append").parquet(f"{out}/{LOG}")

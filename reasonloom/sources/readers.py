"""Corpus sources: Parquet folders and files, JSON lines, globs and splits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reasonloom.session import computed_once
from reasonloom.sources.footers import footers, merged, schemas_of
from reasonloom.sources.paths import (
    glob_free,
    is_directory,
    list_files,
    plain_path,
    relative_path,
    scanned_path,
)

CORPUS_COLUMNS = (
    "problem",
    "generated_solution",
    "problem_type",
    "pass_rate_72b_tir",
    "expected_answer",
)
CORPUS_SCHEMA = StructType([StructField(c, StringType()) for c in CORPUS_COLUMNS])
CORRUPT = "_corrupt_record"


def file_report(rows: DataFrame) -> DataFrame:
    """(path, rows_promised, rows_read) of the scanned files: by their footers, and decoded.

    For rows read with `ignoreCorruptFiles`, under which a damaged file gives only the rows
    before the damage. A file whose footer is unreadable is not listed.
    """
    named = rows.withColumn("path", scanned_path())
    promised = named.groupBy("path").agg(F.count("*").alias("rows_promised"))
    # the hash of all columns is asked for, so that all of them are decoded
    everything = F.max(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    decoded = F.when(everything.isNotNull(), F.count("*")).otherwise(0)
    read = named.groupBy(F.col("path").alias("_path")).agg(decoded.alias("_read"))
    both = promised.join(read, F.col("path") == F.col("_path"), "left")
    n_read = F.coalesce("_read", F.lit(0)).cast("long")
    return both.select("path", "rows_promised", n_read.alias("rows_read"))


def _damaged() -> Column:
    return F.col("rows_read") < F.col("rows_promised")


def _load(reader: DataFrameReader, path: str | list[str], skip_corrupt: bool) -> DataFrame:
    """Read Parquet; nothing readable gives an empty corpus.

    Strict unless told otherwise: a read error stops the job. With `skip_corrupt` a file is used
    whole or not at all, which costs one more read of everything: under Spark's own option a
    damaged file would give part of its rows, and a passing storage error would look like damage.
    """
    paths = [path] if isinstance(path, str) else path
    try:
        if not skip_corrupt:
            return reader.option("ignoreCorruptFiles", False).parquet(*paths)
        rows = reader.option("ignoreCorruptFiles", True).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return SparkSession.active().createDataFrame([], CORPUS_SCHEMA)
    # names of damaged files only: there are few, or the corpus is not worth reading
    damaged = [r["path"] for r in file_report(rows).filter(_damaged()).collect()]
    return rows.filter(~scanned_path().isin(damaged)) if damaged else rows


def read_parquet_dir(
    spark: SparkSession, path: str, pattern: str = "*.parquet", skip_corrupt: bool = False
) -> DataFrame:
    """Files at the top level of a folder. `skipped_files` tells which gave no rows."""
    return _load(spark.read.option("pathGlobFilter", pattern), path, skip_corrupt)


def read_parquet_file(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    return _load(spark.read, path, skip_corrupt)


def skipped_files(
    spark: SparkSession, path: str, pattern: str = "*.parquet", recursive: bool = False
) -> DataFrame:
    """(path, length, rows_promised, rows_read) of the files that a skipping read leaves out.

    These are files with an unreadable footer (no row numbers), damaged ones, and empty ones.
    """
    listed = list_files(spark, path, pattern, recursive).withColumn("path", plain_path(F.col("path")))
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    try:
        rows = reader.option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        none = F.lit(None).cast("long")
        return listed.select("path", "length", none.alias("rows_promised"), none.alias("rows_read"))
    report = listed.join(file_report(rows), "path", "left")
    left_out = F.col("rows_promised").isNull() | (F.col("rows_promised") == 0) | _damaged()
    return report.filter(left_out).select("path", "length", "rows_promised", "rows_read")


ABSENT = "_absent"  # the column that lists what a row's file does not have


def schema_of_file(spark: SparkSession) -> Callable[[str], StructType]:
    """The schema that Spark's reader gives one file, from its footer alone."""
    return lambda path: spark.read.parquet(glob_free(path)).schema


def _type_class(schema: StructType, mixed: set[str]) -> str:
    """Files that agree on the columns of several types can be read together."""
    return str(sorted((f.name, f.dataType.simpleString()) for f in schema if f.name in mixed))


def read_differing(
    spark: SparkSession,
    root: str,
    recursive: bool = False,
    skip_corrupt: bool = False,
    watched: tuple[str, ...] = CORPUS_COLUMNS,
    only: list[str] | None = None,
    row_numbers: bool = False,
) -> DataFrame:
    """Files of a folder whose columns or types may differ, with `source_file`.

    `only` lists the paths to read, as `list_files` with `plain_path` spells them; with
    `row_numbers` a row has its 0-based number in its file, `row_in_file`.

    Footers are read by tasks, and one row per distinct set of columns reaches the driver. Files
    are read together as long as their types agree: one read of the folder, unless a column has
    several types. Then that column is text, and there is one read for each combination of such
    types; only for these the names of the files, but for those of the most frequent combination,
    pass through the driver. A column that a file does not have is null in its rows; those of
    `watched` are listed in the array `_absent`, joined by file where files differ in them.
    """
    found = footers(spark, root, recursive=recursive, only=only)
    broken = found.filter("error IS NOT NULL").first()
    if broken and not skip_corrupt:
        raise ValueError(f"unreadable footer of {broken['path']}: {broken['error']}")
    schemas = schemas_of(spark, found, schema_of_file(spark))
    if not schemas:
        empty = spark.createDataFrame([], CORPUS_SCHEMA)
        none = F.array().cast("array<string>").alias(ABSENT)
        numbers = [F.lit(0).cast("long").alias("row_in_file")] if row_numbers else []
        return empty.select("*", F.lit("").alias("source_file"), *numbers, none)
    _, mixed = merged(list(schemas.values()))
    absent = {key: [c for c in watched if c not in s.names] for key, s in schemas.items()}
    classes: dict[str, list[str]] = {}
    for key, schema in schemas.items():
        classes.setdefault(_type_class(schema, mixed), []).append(key)
    paths = _paths_by_class(found, list(classes.values()), only is None)
    known = {tuple(names) for names in absent.values()}
    parts = []
    for keys, members in zip(classes.values(), paths, strict=True):
        schema, _ = merged([schemas[k] for k in keys])
        reader = spark.read.schema(schema).option("pathGlobFilter", "*.parquet")
        if members is None:
            rows = _load(reader.option("recursiveFileLookup", recursive), root, skip_corrupt)
            others = [p for some in paths if some is not None for p in some]
            rows = rows.filter(~scanned_path().isin(others)) if others else rows
        else:
            rows = _load(reader, [glob_free(p) for p in members], skip_corrupt)
        columns = [
            F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`")
            for c in schema.names
        ]
        path = scanned_path()
        named = [path.alias("_path"), relative_path(path, root).alias("source_file")]
        numbers = [F.col("_metadata.row_index").alias("row_in_file")] if row_numbers else []
        parts.append(rows.select(*columns, *named, *numbers))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(known) == 1:
        same = F.array(*[F.lit(c) for c in next(iter(known))]).cast("array<string>")
        return table.withColumn(ABSENT, same).drop("_path")
    sets = spark.createDataFrame(list(absent.items()), f"columns string, {ABSENT} array<string>")
    of_files = found.select(F.col("path").alias("_path"), "columns").join(F.broadcast(sets), "columns")
    return table.join(of_files.drop("columns"), "_path", "left").drop("_path")


def _paths_by_class(
    found: DataFrame, classes: list[list[str]], whole: bool
) -> list[list[str] | None]:
    """The files of each class of column sets; of a `whole` folder none for the class of most files."""
    if whole and len(classes) == 1:
        return [None]
    counts = {r["columns"]: r["count"] for r in found.groupBy("columns").count().collect()}
    sizes = [sum(counts[k] for k in keys) for keys in classes]
    most = sizes.index(max(sizes)) if whole else None
    return [
        None
        if n == most
        else [r["path"] for r in found.filter(F.col("columns").isin(keys)).select("path").collect()]
        for n, keys in enumerate(classes)
    ]


def _parsed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    row = F.from_json("value", wide, options)
    bad = F.col("row").isNull() | F.col(f"row.{CORRUPT}").isNotNull()
    rows = spark.read.text(path).select("value", row.alias("row"))
    return computed_once(rows, "row").withColumn("bad", bad)


def _whole_schema(spark: SparkSession, path: str) -> StructType:
    """The corpus columns, then all others that the lines have, as text, in one more pass."""
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("key"))
    others = [r["key"] for r in keys.distinct().orderBy("key").collect()]  # column names
    fields = [StructField(k, StringType()) for k in others if k not in (*CORPUS_COLUMNS, CORRUPT)]
    return StructType([*CORPUS_SCHEMA.fields, *fields])


def read_jsonl(
    spark: SparkSession, path: str, schema: StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines). Blank lines, broken text and non-objects are bad.

    Without a schema all columns that occur are kept as text, objects and lists as JSON.
    """
    schema = schema or _whole_schema(spark, path)
    parsed = _parsed(spark, path, schema)
    good = parsed.filter(~F.col("bad")).select(*[f"row.`{f.name}`" for f in schema.fields])
    return good, parsed.filter("bad").select("value")


def count_jsonl(
    spark: SparkSession, path: str, schema: StructType = CORPUS_SCHEMA
) -> DataFrame:
    """(n_good, n_bad) in one pass."""
    return _parsed(spark, path, schema).agg(
        F.count_if(~F.col("bad")).alias("n_good"), F.count_if("bad").alias("n_bad")
    )


def read_corpus(spark: SparkSession, path: str, skip_corrupt: bool = False) -> DataFrame:
    """Choose the source: a folder first, then .jsonl / .json, then .parquet.

    Files of a folder may differ; a corpus column that none of them has is null. `count_jsonl`
    tells how many lines of a JSON source are left out.
    """
    if is_directory(spark, path):
        rows = read_differing(spark, path, skip_corrupt=skip_corrupt).drop(ABSENT, "source_file")
        missing = [c for c in CORPUS_COLUMNS if c not in rows.columns and c != CORPUS_COLUMNS[2]]
        return rows.withColumns({c: F.lit(None).cast("string") for c in missing})
    if path.endswith((".jsonl", ".json")):
        return read_jsonl(spark, path)[0]
    if path.endswith(".parquet"):
        return read_parquet_file(spark, path, skip_corrupt)
    raise ValueError(f"unsupported path: {path}")


def only_below(spark: SparkSession, root: str) -> bool:
    """True if the top level of a folder has no Parquet file."""
    return list_files(spark, root).isEmpty()


def corpus_reader(spark: SparkSession, recursive: bool) -> DataFrameReader:
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    return reader.option("recursiveFileLookup", recursive)


def discover(spark: SparkSession, root: str, skip_corrupt: bool = False) -> DataFrame:
    """Top level of a folder, or everything below it if the top level has no file."""
    return _load(corpus_reader(spark, only_below(spark, root)), root, skip_corrupt)


def read_glob(spark: SparkSession, pattern: str, skip_corrupt: bool = False) -> DataFrame:
    return _load(spark.read, pattern, skip_corrupt)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Files named `<split>-*.parquet`."""
    return read_parquet_dir(spark, path, f"{split}-*.parquet")


def with_source_file(df: DataFrame, root: str) -> DataFrame:
    """Add the file's path below `root` and, for Parquet, the row's number in it."""
    return df.select(
        "*",
        relative_path(scanned_path(), root).alias("source_file"),
        F.col("_metadata.row_index").alias("row_in_file"),
    )

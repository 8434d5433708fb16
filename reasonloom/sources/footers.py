"""What Parquet footers say, read by tasks: columns of each file, row groups, single rows.

A footer is a few KB at the end of a file. Tasks read it through Arrow, on local disks, S3 and GCS;
on other stores the bytes of the files come through Spark's own reader.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reasonloom.operators.ordering import running_total
from reasonloom.session import spread, write_once
from reasonloom.sources.paths import plain_path, relative_path
from reasonloom.sources.stores import opens, store_of

GROUP = "struct<grp: int, first_row: long, n_rows: long, n_bytes: long>"
FOOTER = f"path string, length long, n_rows long, columns string, grps array<{GROUP}>, error string"
TASK_BYTES = 64 << 20  # of row groups that one task of a lookup reads
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"  # fixed value: written by Spark


def columns_of(footer: pq.FileMetaData) -> str:
    """All that a reader's schema follows from; equal for files with equal columns and types."""
    own = (footer.metadata or {}).get(SPARK_SCHEMA, b"").decode()
    fields = [[f.name, str(f.type)] for f in footer.schema.to_arrow_schema()]
    return json.dumps([fields, own])


def groups_of(footer: pq.FileMetaData) -> list[dict]:
    found, first = [], 0
    for k in range(footer.num_row_groups):
        group = footer.row_group(k)
        size = sum(group.column(c).total_compressed_size for c in range(group.num_columns))
        row = {"grp": k, "first_row": first, "n_rows": group.num_rows, "n_bytes": size}
        found.append(row)
        first += group.num_rows
    return found


def _input(path: str, content: bytes | None) -> pa.NativeFile:
    if content is not None:
        return pa.BufferReader(content)
    store, at = store_of(path)
    return store.open_input_file(at)


def _listed(spark: SparkSession, root: str, pattern: str, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    files = reader.option("recursiveFileLookup", recursive).load(root)
    if opens(root):  # the content is not asked for, so it is not read
        return files.select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.select("path", "length", "content")


def footers(
    spark: SparkSession,
    root: str,
    pattern: str = "*.parquet",
    recursive: bool = False,
    only: list[str] | None = None,
) -> DataFrame:
    """A row per file: path, length, n_rows, columns, grps, error; an unreadable footer is an error.

    Of the files listed in `only`, if given. `columns` is a text that is the same for all files of the same columns and types.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = {"path": row["path"], "length": row["length"]}
                try:
                    with _input(row["path"], row["content"]) as data:
                        footer = pq.ParquetFile(data).metadata
                    found |= {"n_rows": footer.num_rows, "columns": columns_of(footer)}
                    found |= {"grps": groups_of(footer)}
                except Exception as error:  # of any kind: it is reported with the file
                    found["error"] = f"{type(error).__name__}: {error}"
                yield pa.RecordBatch.from_pylist([found], schema=arrow)

    arrow = to_arrow_schema(spark.createDataFrame([], FOOTER).schema)
    files = _listed(spark, root, pattern, recursive)
    if only is not None:
        files = files.filter(plain_path(F.col("path")).isin(only))
    made = spread(files).mapInArrow(read, FOOTER)
    return write_once(made.withColumn("path", plain_path(F.col("path"))), "footers")


def schemas_of(
    spark: SparkSession, read: DataFrame, schema_of: Callable[[str], StructType]
) -> dict[str, StructType]:
    """The schema of each distinct set of columns, from one file of each.

    Only one row per distinct set reaches the driver, whatever the number of files.
    """
    sets = read.filter("error IS NULL").groupBy("columns").agg(F.min("path").alias("path"))
    return {r["columns"]: schema_of(r["path"]) for r in sets.sort("path").collect()}


def merged(schemas: list[StructType]) -> tuple[StructType, set[str]]:
    """All columns in the order in which they first come, and those of several types."""
    fields: dict[str, StructField] = {}
    mixed = set()
    for field in (f for schema in schemas for f in schema):
        known = fields.setdefault(field.name, StructField(field.name, field.dataType))
        if known.dataType != field.dataType:
            mixed.add(field.name)
    return StructType(list(fields.values())), mixed


def row_groups(footer_rows: DataFrame, root: str) -> DataFrame:
    """source_file, path, grp, first_idx, first_row, n_rows, n_bytes: a row per row group.

    `first_idx` is the number of the group's first row among all rows of the folder, files in the
    order of their names.
    """
    named = footer_rows.filter("error IS NULL").withColumn(
        "source_file", relative_path(F.col("path"), root)
    )
    offsets = running_total(
        named.select("source_file", "n_rows"), [F.col("source_file")], "n_rows", "row_offset"
    )
    groups = named.select("source_file", "path", F.inline("grps"))
    placed = groups.join(offsets.select("source_file", "row_offset"), "source_file")
    return placed.select(
        "source_file",
        "path",
        "grp",
        (F.col("row_offset") + F.col("first_row")).alias("first_idx"),
        "first_row",
        "n_rows",
        "n_bytes",
    )


def rows_of_group(data: pa.NativeFile, group: int, numbers: list[int], schema: pa.Schema) -> pa.Table:
    """The rows of these numbers in one row group, as the columns of `schema`; null if absent.

    Beside the footer only the bytes of this group are read, and of it only wanted columns.
    """
    source = pq.ParquetFile(data)
    there = set(source.schema_arrow.names)
    table = source.read_row_group(group, columns=[c for c in schema.names if c in there])
    rows = table.take(pa.array(numbers, pa.int64()))
    columns = [
        rows[f.name].cast(f.type, safe=False) if f.name in there else pa.nulls(len(numbers), f.type)
        for f in schema
    ]
    return pa.Table.from_arrays(columns, schema=schema)


def lookup(
    spark: SparkSession,
    root: str,
    indexes: list[int],
    schema_of: Callable[[str], StructType],
    columns: list[str] | None = None,
) -> DataFrame:
    """The rows of a Parquet folder with the given global numbers, with `source_file` and `global_idx`.

    The numbers come from the footers; tasks read the row groups that hold a wanted row and no
    other. A column of differing types is text. Numbers that do not exist raise IndexError. Spark
    reads nested columns in its own way: they may be left out by naming `columns`.
    """
    found = footers(spark, root)
    broken = found.filter("error IS NOT NULL").first()
    if broken:
        raise ValueError(f"{broken['path']}: {broken['error']}")
    schema, mixed = merged(list(schemas_of(spark, found, schema_of).values()))
    kept = [f for f in schema if columns is None or f.name in columns]
    schema = StructType([StructField(f.name, StringType()) if f.name in mixed else f for f in kept])
    groups = row_groups(found, root)
    first, after = F.col("first_idx"), F.col("first_idx") + F.col("n_rows")
    wanted = F.array(*map(F.lit, sorted(set(indexes)))).cast("array<bigint>")
    inside = F.filter(wanted, lambda i: (i >= first) & (i < after))
    places = groups.withColumn("wanted", inside).filter(F.size("wanted") > 0)
    # as many groups and numbers as the caller listed, at most
    chosen = places.select("wanted", "n_bytes").collect()
    there = {i for row in chosen for i in row["wanted"]}
    if there != set(indexes):
        raise IndexError(f"no row {sorted(set(indexes) - there)}")
    out = StructType(
        [*schema, StructField("source_file", StringType()), StructField("global_idx", LongType())]
    )
    arrow, whole = to_arrow_schema(schema), to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                numbers = [i - row["first_idx"] for i in row["wanted"]]
                with _input(row["path"], row.get("content")) as data:
                    rows = rows_of_group(data, row["grp"], numbers, arrow)
                names = pa.array([row["source_file"]] * len(numbers))
                columns = [*rows.columns, names, pa.array(row["wanted"], pa.int64())]
                yield from pa.Table.from_arrays(columns, schema=whole).to_batches()

    if not opens(root):
        content = _listed(spark, root, "*.parquet", False)
        content = content.select(plain_path(F.col("path")).alias("path"), "content")
        places = places.join(content, "path")
    # a number of tasks of our own: by the size of `places` the adaptive planner would make it one
    cores = spark.sparkContext.defaultParallelism
    by_size = -(-sum(row["n_bytes"] for row in chosen) // TASK_BYTES)
    tasks = max(1, min(len(chosen), max(cores, by_size)))
    return places.repartition(tasks, "path", "grp").mapInArrow(read, out)

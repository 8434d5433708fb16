"""Footers read by tasks: differing files, single rows by row group, byte copies, file runs."""

import glob
import hashlib
import os
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from reasonloom.operators import curate, file_runs
from reasonloom.sources import copies, files, footers, readers
from reasonloom.sources.stores import opens, scheme_of, store_of

COLUMNS = ["problem", "generated_solution", "problem_type", "pass_rate_72b_tir"]


def put(folder, name, n, drop=(), rates=None, text="a b"):
    """A file of n rows without the columns in `drop`, written without Spark."""
    rates = rates or ["0.9"] * n
    values = {
        "problem": [f"{name}-{i}" for i in range(n)],
        "generated_solution": [text] * n,
        "problem_type": ["has_answer_extracted"] * n,
        "pass_rate_72b_tir": rates,
    }
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(pa.table({c: v for c, v in values.items() if c not in drop}), path)
    return path


def tear(path):
    """Overwrite data in the middle of a file; its footer stays."""
    with open(path, "r+b") as out:
        out.seek(4)
        out.write(b"\xff" * (os.path.getsize(path) // 4))


@pytest.fixture
def folder(tmp_path):
    made = tmp_path / "corpus of odd 100%25 + names"
    made.mkdir()
    return str(made)


def jobs_of(spark, work):
    """The number of Spark jobs that a call runs."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        result = work()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_no_job_per_file(spark, tmp_path):
    few, many = str(tmp_path / "few"), str(tmp_path / "many")
    for folder, n in ((few, 4), (many, 2000)):
        first = {k: put(folder, f"{k}.parquet", 2, ["pass_rate_72b_tir"] if k else []) for k in (0, 1)}
        for i in range(2, n):
            shutil.copy(first[i % 2], f"{folder}/{i}.parquet")
    rows, jobs_few = jobs_of(spark, lambda: readers.read_differing(spark, few))
    assert rows.count() == 8
    rows, jobs_many = jobs_of(spark, lambda: readers.read_differing(spark, many))
    assert jobs_many <= 3 * jobs_few < 40  # the adaptive planner runs a stage more here and there
    counts = rows.groupBy(F.size("_absent").alias("n")).count().collect()
    assert {r["n"]: r["count"] for r in counts} == {1: 2000, 2: 2000}  # expected_answer is always absent


def test_columns_absent_by_file(spark, folder):
    put(folder, "a.parquet", 3)
    put(folder, "b.parquet", 2, ["pass_rate_72b_tir"])
    put(folder, "c.parquet", 4, ["problem", "pass_rate_72b_tir"])
    rows = readers.read_differing(spark, folder).collect()
    absent = {r["source_file"]: set(r["_absent"]) - {"expected_answer"} for r in rows}
    assert absent == {
        "a.parquet": set(), "b.parquet": {"pass_rate_72b_tir"}, "c.parquet": {"problem", "pass_rate_72b_tir"}
    }
    assert len(rows) == 9 and all(r["problem"] is None for r in rows if r["source_file"] == "c.parquet")


def test_types_that_differ(spark, folder):
    put(folder, "a.parquet", 3)
    put(folder, "b.parquet", 2)
    put(folder, "numbers [1].parquet", 2, rates=[0.5, 0.95])
    put(folder, "whole.parquet", 1, rates=[1])
    rows = readers.read_differing(spark, folder)
    got = {(r["source_file"], r["pass_rate_72b_tir"]) for r in rows.collect()}
    assert rows.count() == 8 and got == {
        ("a.parquet", "0.9"), ("b.parquet", "0.9"), ("numbers [1].parquet", "0.5"),
        ("numbers [1].parquet", "0.95"), ("whole.parquet", "1"),
    }
    kept = curate.curate(curate.read_files(spark, folder)).groupBy("source_file").count().collect()
    assert {r[0]: r[1] for r in kept} == {
        "a.parquet": 3, "b.parquet": 2, "numbers [1].parquet": 1, "whole.parquet": 1
    }


def test_unreadable_footers(spark, folder):
    put(folder, "a.parquet", 3)
    with open(f"{folder}/bad.parquet", "w") as bad:
        bad.write("junk")
    with pytest.raises(ValueError, match="bad.parquet"):
        readers.read_differing(spark, folder)
    assert readers.read_differing(spark, folder, skip_corrupt=True).count() == 3
    found = {os.path.basename(r["path"]): r for r in footers.footers(spark, folder).collect()}
    assert found["a.parquet"]["n_rows"] == 3 and found["bad.parquet"]["error"]


# Single rows


@pytest.fixture
def grouped(folder):
    """Three files of twenty row groups each, of 100 rows of 2 KB; one lacks a column."""
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest() * 64) for i in range(6000)]
    for k in range(3):
        ids, texts = zip(*rows[2000 * k : 2000 * (k + 1)], strict=True)
        columns = {"id": ids, "text": texts} | ({"level": [k] * 2000} if k else {})
        pq.write_table(pa.table(columns), f"{folder}/part {k}.parquet", row_group_size=100, compression="none")
    return folder


def test_lookup(spark, grouped):
    schema_of = readers.schema_of_file(spark)
    wanted = [0, 99, 100, 1999, 2000, 4321, 5999]
    found = footers.lookup(spark, grouped, wanted, schema_of)
    got = sorted((r["global_idx"], r["id"], r["level"], r["source_file"]) for r in found.collect())
    assert got == [
        (i, i, None if i < 2000 else i // 2000, f"part {i // 2000}.parquet") for i in wanted
    ]
    assert footers.lookup(spark, grouped, [], schema_of).count() == 0
    for wrong in (-1, 6000):
        with pytest.raises(IndexError):
            footers.lookup(spark, grouped, [1, wrong], schema_of)
    by_file = files.rows_at(spark, grouped, wanted)  # the older way, on the same odd path
    assert sorted(r["id"] for r in by_file.collect()) == wanted


def test_lookup_deals_row_groups_to_tasks(spark, grouped, monkeypatch):
    schema_of = readers.schema_of_file(spark)
    found = footers.lookup(spark, grouped, list(range(0, 6000, 100)), schema_of)
    tasks = found.select(F.spark_partition_id().alias("task"), "id").collect()
    assert [r["id"] for r in sorted(tasks, key=lambda r: r["id"])] == list(range(0, 6000, 100))
    assert len({r["task"] for r in tasks}) > 2  # of sixty groups, on eight cores
    monkeypatch.setattr(footers, "TASK_BYTES", 1 << 18)  # a group has 0.2 MB
    found = footers.lookup(spark, grouped, list(range(0, 6000, 100)), schema_of)
    assert len({r["task"] for r in found.select(F.spark_partition_id().alias("task")).collect()}) > 16


def test_lookup_reads_one_row_group(grouped):
    class Counting:
        """A file that adds up the bytes read from it."""

        def __init__(self, path):
            self.inner, self.n = open(path, "rb"), 0

        def read(self, n=-1):
            data = self.inner.read(n)
            self.n += len(data)
            return data

        def __getattr__(self, name):
            return getattr(self.inner, name)

    path = f"{grouped}/part 1.parquet"
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("absent", pa.string())])
    data = Counting(path)
    rows = footers.rows_of_group(pa.PythonFile(data, "r"), 7, [0, 99], schema)
    assert rows["id"].to_pylist() == [2700, 2799] and rows["absent"].null_count == 2
    assert data.n < os.path.getsize(path) / 10  # the footer, and one group of twenty
    data = Counting(path)
    footers.rows_of_group(pa.PythonFile(data, "r"), 7, [0], pa.schema([("id", pa.int64())]))
    assert data.n < os.path.getsize(path) / 20  # the footer, and one small column


def test_lookup_of_differing_types(spark, folder):
    put(folder, "a.parquet", 2)
    put(folder, "b.parquet", 2, rates=[0.25, 0.75])
    found = footers.lookup(spark, folder, [1, 3], readers.schema_of_file(spark))
    assert sorted(r["pass_rate_72b_tir"] for r in found.collect()) == ["0.75", "0.9"]


# Copies


def test_copies_are_byte_for_byte(spark, folder, tmp_path):
    for i in range(12):
        put(folder, f"f {i}.parquet", i + 1, rates=[0.5] * (i + 1) if i % 2 else None)
    target = str(tmp_path / "target")
    manifest = copies.sample_copies(spark, folder, target, count=5).collect()
    there = {os.path.basename(p) for p in glob.glob(f"{target}/*.parquet")}
    assert there == {r["source_file"] for r in manifest} and len(there) == 5
    for r in manifest:
        source, copied = (open(f"{x}/{r['source_file']}", "rb").read() for x in (folder, target))
        assert source == copied and r["n_bytes"] == len(source) and r["error"] is None
        assert r["md5"] == hashlib.md5(source).hexdigest()
    assert not glob.glob(f"{target}/*.part")
    rows = readers.with_source_file(readers.read_parquet_dir(spark, folder, "f 0.parquet"), folder)
    same = files.sample_files(rows, count=5, listing=spark.createDataFrame(
        [(f"f {i}.parquet",) for i in range(12)], "source_file string"))
    assert same.isEmpty() == ("f 0.parquet" not in there)  # both take the same files
    again = copies.sample_copies(spark, folder, target, count=5).collect()
    assert {r["md5"] for r in again} == {r["md5"] for r in manifest}


def test_a_file_that_cannot_be_copied(spark, folder, tmp_path):
    for i in range(3):
        put(folder, f"{i}.parquet", 2)
    chosen = spark.createDataFrame(
        [(f"{i}.parquet", f"{folder}/{i}.parquet", os.path.getsize(f"{folder}/{i}.parquet")) for i in range(3)]
        + [("gone.parquet", f"{folder}/gone.parquet", 7), ("short.parquet", f"{folder}/0.parquet", 7)],
        "source_file string, path string, length long",
    )
    target = str(tmp_path / "target")
    with pytest.raises(OSError, match="2 files not copied"):
        copies.copy_files(chosen, target)
    manifest = copies.copy_files(chosen, target, skip_failing=True)
    failed = {r["source_file"] for r in manifest.filter("error IS NOT NULL").collect()}
    assert failed == {"gone.parquet", "short.parquet"}
    assert {os.path.basename(p) for p in glob.glob(f"{target}/[0-9].parquet")} == {f"{i}.parquet" for i in range(3)}


def test_stores():
    assert scheme_of("/a:b/c") == scheme_of("file:/a") == "file" and scheme_of("s3a://b/c") == "s3a"
    assert store_of("file:///a b/c%20d")[1] == store_of("/a b/c%20d")[1] == "/a b/c%20d"
    assert opens("gs://b/c") and not opens("viewfs://store/c")
    with pytest.raises(ValueError):
        store_of("viewfs://store/c")


# File runs


def test_a_failing_file_does_not_stop_the_others(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for i in range(9):
        put(folder, f"{i}.parquet", i + 1, rates=["0.9"] * i + ["0.1"])
    torn = put(folder, "torn.parquet", 4000, text="x y " * 50)
    tear(torn)
    with open(f"{folder}/bad.parquet", "w") as bad:
        bad.write("junk")
    log = {r["source_file"]: r for r in file_runs.curate_each(spark, folder, out, parts=3).collect()}
    assert {f for f, r in log.items() if r["status"] == "failed"} == {"torn.parquet", "bad.parquet"}
    assert all(r["error"] for r in log.values() if r["status"] == "failed")
    assert {f: r["n_rows"] for f, r in log.items() if r["status"] == "done"} == {f"{i}.parquet": i for i in range(9)}
    kept = spark.read.parquet(out).groupBy("source_file").count().collect()
    assert {r[0]: r[1] for r in kept} == {f"{i}.parquet": i for i in range(1, 9)}

    # mended and changed files alone are worked on again
    before = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/source_file=*/*.parquet")}
    put(folder, "torn.parquet", 2)
    put(folder, "8.parquet", 20)
    waiting = {r["source_file"] for r in file_runs.pending_files(spark, folder, out).collect()}
    assert waiting == {"torn.parquet", "bad.parquet", "8.parquet"}
    log = {r["source_file"]: r for r in file_runs.curate_each(spark, folder, out).collect()}
    assert {f for f, r in log.items() if r["status"] == "failed"} == {"bad.parquet"}
    assert log["8.parquet"]["n_rows"] == 20 and log["torn.parquet"]["n_rows"] == 2
    kept = spark.read.parquet(out).groupBy("source_file").count().collect()
    assert {r[0]: r[1] for r in kept} == {f"{i}.parquet": i for i in range(1, 8)} | {"8.parquet": 20, "torn.parquet": 2}
    after = {p: os.path.getmtime(p) for p in glob.glob(f"{out}/source_file=*/*.parquet")}
    assert all(after.get(p) == t for p, t in before.items() if "=8.parquet" not in p)


def test_all_files_fail_or_none(spark, folder, tmp_path):
    with open(f"{folder}/bad.parquet", "w") as bad:
        bad.write("junk")
    out = str(tmp_path / "out")
    assert [r["status"] for r in file_runs.curate_each(spark, folder, out).collect()] == ["failed"]
    os.remove(f"{folder}/bad.parquet")
    empty = str(tmp_path / "empty")
    os.makedirs(empty)
    assert file_runs.curate_each(spark, empty, str(tmp_path / "none")).count() == 0
    put(folder, "a.parquet", 2, rates=["0.1", "0.2"])
    log = file_runs.curate_each(spark, folder, out).filter("source_file = 'a.parquet'").first()
    assert (log["status"], log["n_rows"]) == ("done", 0)

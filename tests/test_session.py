"""The shared folder and the helpers that write to it or steer the optimizer."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from reasonloom import session


def fake(master, conf):
    context = SimpleNamespace(master=master, folder=None)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", path)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_a_cluster_must_name_its_folder():
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake("yarn", {}))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake("local-cluster[2,1,1024]", {}))
    named = fake("yarn", {"spark.checkpoint.dir": "s3://bucket/tmp"})
    assert session.ensure_checkpoint_dir(named) == "s3://bucket/tmp"
    assert session.ensure_checkpoint_dir(fake("local[2]", {})).count("reasonloom-") == 1


def test_write_once_gives_the_same_rows(spark):
    rows = spark.range(100).select("id", F.array("id").alias("a"), F.lit(None).cast("int").alias("n"))
    back = session.write_once(rows, "rows")
    assert back.exceptAll(rows).isEmpty() and back.count() == 100
    assert back.dtypes == rows.dtypes


def test_spread_leaves_large_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert session.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 1000, 1, cores + 3)
    assert session.spread(wide) is wide


def test_computed_once_keeps_filters_above(spark):
    rows = spark.range(10).withColumn("x", F.sha2(F.col("id").cast("string"), 256))
    text = session.computed_once(rows, "x").filter("x > 'a'")._jdf.queryExecution().executedPlan().toString()
    assert text.count("sha2(") == 1
    assert session.computed_once(rows, "x").count() == 10


def test_scratch_tables_are_removed(spark):
    from pathlib import Path

    session.write_once(spark.range(3), "gone").count()
    folder = Path(session.scratch_path(spark, "x").removeprefix("file:")).parent
    assert folder.is_dir() and any(folder.iterdir())
    session.remove_scratch(spark)
    assert not folder.exists()
    assert session.write_once(spark.range(3), "again").count() == 3

"""Batches on disk are read back by rank, in order, from any batch on."""

import pytest
from pyspark.sql import functions as F

from reasonloom.operators import rank_files


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ranks") / "with a blank")
    batches = spark.range(1000).select(
        (F.col("id") % 3).alias("shard"),
        (F.floor(F.col("id") / 3)).alias("batch_id"),
        F.array_repeat("id", 5).alias("input_ids"),
    )
    index = rank_files.write_ranks(batches.repartition(5), folder, files=12)
    return folder, index.collect()


def test_index(written):
    _, index = written
    assert sum(r["n_batches"] for r in index) == 1000 and len(index) >= 12
    for shard in range(3):
        mine = sorted((r["first_batch"], r["last_batch"]) for r in index if r["shard"] == shard)
        assert len(mine) >= 3 and mine[0][0] == 0
        assert all(a[1] + 1 == b[0] for a, b in zip(mine, mine[1:]))  # no batch in two files


@pytest.mark.parametrize("start", [0, 1, 150, 332])
def test_order_and_resume(spark, written, start):
    folder, _ = written
    for shard in range(3):
        n = 334 if shard == 0 else 333
        rows = list(rank_files.iterate_rank(spark, folder, shard, start))
        assert [r["batch_id"] for r in rows] == list(range(start, n))
        assert all(r["input_ids"] == [3 * r["batch_id"] + shard] * 5 and r["shard"] == shard for r in rows)
        some = rank_files.read_rank(spark, folder, shard, start)
        assert sorted(r["batch_id"] for r in some.collect()) == list(range(start, n))


def test_only_needed_files_are_read(spark, written):
    folder, index = written
    late = rank_files.read_rank(spark, folder, 1, 300)
    assert 1 <= len(late.inputFiles()) < sum(r["shard"] == 1 for r in index)
    assert all("shard=1" in name for name in late.inputFiles())
    assert rank_files.read_rank(spark, folder, 1, 10_000).isEmpty()
    assert rank_files.read_rank(spark, folder, 9).isEmpty()
    assert list(rank_files.iterate_rank(spark, folder, 9)) == []

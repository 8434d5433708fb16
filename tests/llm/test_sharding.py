"""Shards: all rows once, gapless slots, near-equal bytes, copies together where they fit."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reasonloom.llm import queries, sharding
from reasonloom.llm.sharding import KEY, ShardConfig, find_range

LONGEST = 60


def check(rows, docs, n_shards, slack):
    """Rows of the digest: the documents themselves, in gapless slots of nearly equal shards."""
    size = lambda text: len((text or "").encode()) + 1
    crc = lambda text: zlib.crc32((text or "").encode())
    key = lambda r: tuple((x is None, x) for x in r)
    wanted = [(d["doc_id"], size(d["text"]), crc(d["text"])) for d in docs]
    got = [(r["doc_id"], r["size"], r["text_crc32"]) for r in rows]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    slots = defaultdict(list)
    filled = dict.fromkeys(range(n_shards), 0)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        filled[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    due = sum(filled.values()) / n_shards
    assert all(abs(f - due) <= slack(due) for f in filled.values()), filled


def groups(rows):
    shards, sizes = defaultdict(set), defaultdict(int)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
        sizes[r["text_crc32"]] += r["size"]
    return shards, sizes


def test_query(spark, medium_dir):
    rows = queries.op11_sharding(spark, medium_dir)
    kinds = dict(rows.dtypes)
    assert kinds == {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
        "shard": "int", "slot": "bigint", "grown_shard": "int",
    }
    docs = spark.read.parquet(f"{medium_dir}/documents.parquet").collect()
    rows = rows.collect()
    longest = max(len(d["text"].encode()) for d in docs)
    check(rows, docs, 8, lambda due: longest + 0.01 * due)
    assert all(len(s) == 1 for s in groups(rows)[0].values())


@pytest.fixture(scope="module")
def copies(spark):
    """Half of 12,000 rows are copies of one text; some groups fit into a shard, most are single."""
    i = F.col("doc_id")
    text = F.when(i % 2 == 0, F.repeat(F.lit("copy "), 8)).when(
        i % 20 == 1, F.repeat(F.concat(F.lit("g"), (i % 60).cast("string"), F.lit(" ")), 10)
    )
    text = F.coalesce(text, F.concat(F.lit("text "), F.sha2(i.cast("string"), 256)).substr(1, LONGEST))
    rows = spark.range(12_000).withColumnRenamed("id", "doc_id").withColumn("text", text)
    return rows.repartition(7).cache()


def test_heavy_groups_are_subdivided(spark, copies):
    cfg = ShardConfig(ranges_per_shard=8, samples=4)
    rows = sharding.digest(sharding.shard(copies, cfg)).collect()
    check(rows, copies.collect(), 8, lambda due: 2 * LONGEST + 0.02 * due)
    shards, sizes = groups(rows)
    due = sum(sizes.values()) / 8
    assert sum(len(s) > 1 for s in shards.values()) == 1  # only the group that fits nowhere
    assert max(len(s) for s in shards.values()) >= 4 and max(sizes.values()) > 2 * due


def test_overfull_ranges_are_subdivided(copies):
    coarse = sharding.plan(copies, ShardConfig(ranges_per_shard=8, samples=1))
    assert coarse.rounds > 0
    due = coarse.size.sum() / 64
    assert coarse.size.max() <= 2 * due + LONGEST
    # a placed group or a part of one may hold no more than a range either
    assert (np.diff(coarse.splitters["h"]) >= 0).all()


def test_same_result_on_other_partitions(copies):
    def places(rows):
        return sorted(map(tuple, rows.select("doc_id", "shard", "slot").collect()))

    assert places(sharding.shard(copies)) == places(sharding.shard(copies.repartition(3, "doc_id")))


def test_find_range():
    splitters = np.array([(-5, -(2**63)), (3, -7), (3, 4), (9, -(2**63))], KEY)
    keys = [(-9, 0), (-5, -(2**63)), (3, -8), (3, -7), (3, 4), (3, 9), (4, 0), (9, 1)]
    h, t = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    assert find_range(splitters, h, t).tolist() == [0, 1, 1, 2, 3, 3, 3, 4]


@pytest.mark.parametrize("n_shards", [1, 3])
def test_odd_rows(odd_documents, n_shards):
    docs = odd_documents.withColumns({"h": F.lit(1), "shard": F.lit("clash"), "At": F.lit(2)})
    sharded = sharding.shard(docs, ShardConfig(n_shards=n_shards))
    assert set(sharded.columns) == {*docs.columns, "slot"}
    longest = docs.agg(F.max(F.octet_length("text"))).first()[0]
    check(sharding.digest(sharded).collect(), docs.collect(), n_shards, lambda due: 2 * longest)
    assert sharding.digest(sharding.shard(docs.limit(0))).count() == 0


def test_equal_rows_and_few_rows(spark):
    same = spark.range(50).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows = sharding.digest(sharding.shard(same)).collect()
    assert len(rows) == 50 and sorted(r["slot"] for r in rows) == list(range(50))
    two = spark.range(2).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sharding.digest(sharding.shard(two)).count() == 2


def test_files(spark, tmp_path, copies):
    folder = str(tmp_path / "shards")
    sharding.write_shards(copies, folder)
    read = spark.read.parquet(folder)
    assert read.count() == 12_000 and read.select("shard").distinct().count() == 8
    direct = sharding.shard(copies).select("doc_id", "text", "slot", "shard")
    assert sorted(map(tuple, read.select(*direct.columns).collect())) == sorted(
        map(tuple, direct.collect())
    )


def test_a_text_moves_once(small_documents):
    plan = sharding.shard(small_documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1

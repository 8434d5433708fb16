"""Ids from dictionaries of blocks equal those from a join of every token."""

import random

import pytest
from pyspark.sql import functions as F

from reasonloom.operators import vocab

SCHEMA = "example_id long, tokens array<string>, n_tok int"


@pytest.fixture(scope="module")
def made(spark):
    rnd = random.Random(7)
    words = [f"w{k}" for k in range(300)] + ["<think>", "é", "漢", "", "🙂"]
    rows = [(k, rnd.choices(words, k=rnd.choice([0, 1, 5, 200])), k) for k in range(400)]
    rows += [(1000, ["hot"] * 5000, 1), (1001, [], 2), (None, ["w1", "w2"], 3), (5, ["w9"], 4)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6).cache()


def by_rows(examples, words):
    """Every token joined by itself."""
    rows = vocab.encode(vocab.token_rows(examples.withColumn("u", F.monotonically_increasing_id()), "u"), words)
    return sorted(map(tuple, rows.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("x")).select(
        F.transform("x", lambda p: p["id"]).cast("string")).collect()))


@pytest.mark.parametrize("size", [1, 64, 1 << 18])
@pytest.mark.parametrize("head", [65_536, 20])
def test_ids(made, monkeypatch, size, head):
    monkeypatch.setattr(vocab, "BLOCK_TOKENS", size)
    monkeypatch.setattr(vocab, "HEAD_IDS", head)
    blocks = vocab.token_blocks(made, carry=("n_tok",))
    words = vocab.build_vocab(vocab.block_tokens(blocks))
    from_rows = vocab.build_vocab(vocab.token_rows(made))
    assert sorted(map(tuple, words.collect()), key=str) == sorted(map(tuple, from_rows.collect()), key=str)
    found = vocab.encode_blocks(blocks, words)
    assert found.columns == ["example_id", "n_tok", "token_ids"] and found.count() == made.count()
    got = sorted((str(r["token_ids"]),) for r in found.collect() if r["token_ids"])
    assert got == by_rows(made, words)
    kept = {(r["example_id"], r["n_tok"]): len(r["token_ids"]) for r in found.collect()}
    assert kept == {(r["example_id"], r["n_tok"]): len(r["tokens"]) for r in made.collect()}


def test_a_token_is_looked_up_once_a_block(made):
    blocks = vocab.token_blocks(made.coalesce(2))
    tokens = vocab.block_tokens(blocks)
    n_blocks = tokens.select("block").distinct().count()
    assert n_blocks <= 4 and tokens.filter("token = 'hot'").count() == 1
    assert tokens.filter("token = 'hot'").first()["n"] == 5000
    assert tokens.groupBy("block", "token").count().filter("count > 1").isEmpty()


def test_tokens_outside_the_vocabulary(spark, made):
    words = spark.createDataFrame([("w1", 7), ("w2", 8)], "token string, id long")
    ids = vocab.encode_examples(made.filter("example_id IS NULL OR example_id >= 1000"), words, carry=())
    assert {r["example_id"]: r["token_ids"] for r in ids.collect()} == {1000: [], 1001: [], None: [7, 8]}
    whole = vocab.encode_examples(made.filter("example_id < 50 AND example_id <> 5"), words)
    assert set(whole.columns) == {*made.columns, "token_ids"} and whole.filter("token_ids IS NULL").isEmpty()
    assert vocab.encode_examples(made.limit(0), words, carry=()).isEmpty()

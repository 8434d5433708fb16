"""Losses from chunks of logits against plain arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reasonloom.operators import logits, scores

INF = float("inf")
SCHEMA = "example_id long, i long, first_id long, logits array<float>, label long"


def plain(values, label):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) - values[label]


def cut(rnd, key, values, label):
    """A position's logits in chunks of uneven sizes."""
    rows, at = [], 0
    while at < len(values):
        size = rnd.randint(1, 700)
        rows.append((*key, at, values[at : at + size], label))
        at += size
    return rows


@pytest.fixture(scope="module")
def positions():
    rnd = random.Random(3)
    made = {}
    for i in range(40):
        scale = rnd.choice([1.0, 30.0, 1000.0])
        made[(i % 3, i)] = ([float(int(rnd.gauss(0, scale) * 8)) / 8 for _ in range(rnd.randint(1, 5000))], i)
    return {k: (v, rnd.randrange(len(v))) for k, (v, _) in made.items()}


def test_real_vocabulary(spark, positions):
    rnd = random.Random(5)
    rows = [r for key, (values, label) in positions.items() for r in cut(rnd, key, values, label)]
    rnd.shuffle(rows)
    chunks = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {(r["example_id"], r["i"]): r for r in logits.chunked_ce(chunks, ("example_id", "i")).collect()}
    assert found.keys() == positions.keys()
    for key, (values, label) in positions.items():
        assert found[key]["n_ids"] == len(values)
        assert found[key]["ce"] == pytest.approx(plain(values, label), rel=1e-9, abs=1e-9)


def test_odd_chunks(spark):
    rows = [
        (0, 0, 0, [1.0, -INF], 0), (0, 0, 2, [-INF, -INF], 0),  # a chunk that is masked as a whole
        (0, 1, 0, [1.0, 2.0], -100), (0, 2, 0, [1.0], None), (0, 3, 0, [1.0], 5),
        (0, 4, 0, [3.0, 3.0], 1), (0, 4, 2, None, 1), (0, 4, 2, [], 1),
        (0, 5, 0, None, 0), (0, 6, 0, [700.0, 800.0], 0), (0, 6, 2, [-900.0], 0),
    ]
    found = logits.chunked_ce(spark.createDataFrame(rows, SCHEMA), ["example_id", "i"]).collect()
    ce = {r["i"]: r["ce"] for r in found}
    assert ce[0] == pytest.approx(0) and ce[4] == pytest.approx(math.log(2)) and ce[6] == pytest.approx(100)
    assert ce[1] is ce[2] is ce[3] is ce[5] is None
    empty = spark.createDataFrame([], SCHEMA)
    assert logits.chunked_ce(empty, "i").isEmpty() and logits.logit_gaps(empty, "i", 4).isEmpty()


def test_gaps(spark):
    rows = [
        (0, 0, 0, [0.0] * 3, 0), (0, 0, 3, [0.0], 0),
        (0, 1, 0, [0.0] * 3, 0), (0, 2, 0, [0.0] * 2, 0), (0, 2, 1, [0.0] * 3, 0),
        (0, 3, 1, [0.0] * 3, 0), (0, 4, 0, [0.0] * 4, 0), (0, 4, 0, [0.0] * 4, 0), (0, 5, 0, [0.0] * 5, 0),
    ]
    gaps = logits.logit_gaps(spark.createDataFrame(rows, SCHEMA), "i", 4)
    assert {r["i"] for r in gaps.collect()} == {1, 2, 3, 4, 5}


def test_no_logit_is_shuffled(spark, positions):
    rows = [(*k, 0, v, label) for k, (v, label) in positions.items()]
    plan = logits.chunked_ce(spark.createDataFrame(rows, SCHEMA), ("example_id", "i"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1  # the window and the sums share it
    after = text.split("Exchange")[0]
    assert "logits" not in after


def test_losses_feed_the_scores(spark):
    rows = [(0, i, 0, [0.0, float(i)], 1) for i in range(1, 4)]
    losses = logits.chunked_ce(spark.createDataFrame(rows, SCHEMA), ("example_id", "i"))
    losses = losses.select("example_id", "i", F.col("ce").alias("loss"))
    made = spark.createDataFrame(
        [(0, 7, ["q", "a", "b", "c"], 4, 1, 0, 0)],
        "example_id long, batch_id long, tokens array<string>, n_tok int, target_start int, answer_lo int, answer_hi int",
    )
    base = scores.base_loss(scores.score_tokens(made, losses, ("batch_id",)), "batch_id").first()
    assert base["base"] == pytest.approx(sum(math.log(1 + math.exp(-i)) for i in (1, 2, 3)) / 3)

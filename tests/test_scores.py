"""Scores: hand-worked values and an emulation."""

import math

import pytest
from pyspark.sql import functions as F

import emulation
from reasonloom.functions import losses
from reasonloom.operators import examples, scores
from reasonloom.plans.reasoning import SYSTEM_PROMPT, reasoning

CFG = examples.ExampleConfig(max_length=256)
COLUMNS = "example_id long, problem string, generated_solution string, batch_id long"


def made(spark, solutions):
    rows = [(i, "q", s, i % 2) for i, s in enumerate(solutions)]
    return examples.build_examples(spark.createDataFrame(rows, COLUMNS), CFG)


def constant_losses(rows, value):
    return rows.select(
        "example_id", F.posexplode("tokens").alias("i", "token"), F.lit(value).alias("loss")
    ).drop("token")


def test_repetition_by_hand(spark):
    rows = made(
        spark,
        [
            r"<think>a b c d a b c d</think>\boxed{1}",
            r"<think>a b c d</think>\boxed{1}",
            r"\boxed{1}",
        ],
    )
    got = scores.repetition(rows).collect()
    assert [(r.example_id, r.n_grams, r.score) for r in got] == [(0, 5, 0.2)]
    off = scores.repetition(rows, cfg=scores.ScoreConfig(repetition_coeff=0.0)).collect()
    assert [r.score for r in off] == [0.0]


def test_ngrams_do_not_run_together(spark):
    rows = spark.createDataFrame([(["1", ":1", "11", "a"],), (["1:", "1", "11", "a"],)], "t array<string>")
    grams = rows.select(losses.ngrams(F.col("t"), 2).alias("g")).collect()
    assert len({g for r in grams for g in r.g}) == 5  # only ("11", "a") is shared
    short = spark.createDataFrame([(["a"],), ([],)], "t array<string>")
    assert [r[0] for r in short.select(losses.ngrams(F.col("t"), 2)).collect()] == [[], []]


def test_efficiency_by_hand(spark):
    rows = made(spark, [r"\boxed{7}", r"\boxed{1 2 3 4}", "no answer"])
    scored = scores.score_tokens(rows, constant_losses(rows, 0.5))
    got = {r.example_id: (r.n_ans, r.score) for r in scores.efficiency(scored).collect()}
    assert set(got) == {0, 1}
    assert got[0][0] == 1 and math.isclose(got[0][1], -0.05 / 1.000001 + 0.05, abs_tol=1e-12)
    assert got[1][0] == 4
    assert math.isclose(got[1][1], -0.1 / 4.000001 * 0.5 + 0.1 * 4 * 0.5, abs_tol=1e-12)


def test_marker_weight(spark):
    rows = made(spark, [r"<think>a</think>\boxed{7}"])
    scored = scores.score_tokens(rows, constant_losses(rows, 1.0), ("batch_id",))
    # Target: <think> a </think> \ boxed { 7 } with two tags of weight 10.
    base = scores.base_loss(scored, "batch_id").first().base
    assert math.isclose(base, (2 * 10 + 6) / 8)
    assert scored.filter("not target and weight <> 0").isEmpty()


def test_a_part_without_weight_is_left_out(spark):
    rows = made(spark, [r"<think>a b c d a b c d</think>\boxed{1}", "none"])
    cfg = scores.ScoreConfig(efficiency_weight=0.0, repetition_weight=0.0)
    for row in scores.combined(rows, constant_losses(rows, 1.0), "batch_id", cfg).collect():
        assert (row.eff, row.rep, row.total) == (0.0, 0.0, row.base)


def test_batch_without_scored_example_gets_zero(spark):
    rows = made(spark, [r"\boxed{7}", "no answer at all"])
    scored = scores.score_tokens(rows, constant_losses(rows, 1.0), ("batch_id",))
    eff = {r.batch_id: r.eff for r in scores.efficiency_batch(scored, "batch_id").collect()}
    assert eff[1] == 0.0 and eff[0] != 0.0
    rep = {r.batch_id: r.rep for r in scores.repetition_batch(rows, "batch_id").collect()}
    assert rep == {0: 0.0, 1: 0.0}


def test_combined_equals_its_parts(spark):
    rows = made(
        spark,
        [
            r"<think>a b c d a b c d</think>\boxed{1}",
            r"<think>x y x y x y</think>\boxed{2 3}",
            r"\boxed{4}",
            "nothing",
        ],
    )
    loss = rows.select("example_id", F.posexplode("tokens").alias("i", "t")).select(
        "example_id", "i", (F.length("t") / 3.0).alias("loss")
    )
    scored = scores.score_tokens(rows, loss, ("batch_id",))
    base = {r.batch_id: r.base for r in scores.base_loss(scored, "batch_id").collect()}
    eff = {r.batch_id: r.eff for r in scores.efficiency_batch(scored, "batch_id").collect()}
    rep = {r.batch_id: r.rep for r in scores.repetition_batch(rows, "batch_id").collect()}
    for r in scores.combined(rows, loss, "batch_id").collect():
        parts = (base[r.batch_id], eff[r.batch_id], rep[r.batch_id])
        assert (r.base, r.eff, r.rep) == pytest.approx(parts)
        assert r.total == pytest.approx(parts[0] + 0.1 * parts[1] + 0.05 * parts[2])


def test_repetition_against_emulation(spark, small_dir):
    cfg = examples.ExampleConfig(max_length=1024, system_prompt=SYSTEM_PROMPT)
    rows = examples.build_examples(reasoning(spark, small_dir), cfg)
    got = {r.example_id: r.score for r in scores.repetition(rows).collect()}
    wanted = {}
    for r in rows.collect():
        if r.think_close is not None:
            score = emulation.repetition(r.tokens[r.think_open + 1 : r.think_close])
            if score is not None:
                wanted[r.example_id] = score
    assert got == pytest.approx(wanted) and any(wanted.values())


def test_cross_entropy(spark):
    rows = spark.createDataFrame(
        [([1000.0, 1000.0], 0), ([0.0, 1.0, 2.0], 2), ([1.0], 5)], "x array<double>, y int"
    )
    got = [r[0] for r in rows.select(losses.token_ce("x", "y")).collect()]
    assert got[0] == pytest.approx(math.log(2))
    assert got[1] == pytest.approx(math.log(sum(math.exp(v - 2) for v in (0, 1, 2))))
    assert got[2] is None


def test_batches_of_several_columns(spark):
    rows = made(spark, [r"\boxed{7}", r"\boxed{1 2 3 4}", r"\boxed{5}", "no answer"])
    rows = rows.withColumn("shard", (F.col("example_id") > 1).cast("long"))
    given = constant_losses(rows, 0.5)
    got = scores.combined(rows, given, ("shard", "batch_id"))
    assert got.columns == ["shard", "batch_id", "base", "eff", "rep", "total"]
    assert sorted((r.shard, r.batch_id) for r in got.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    one = {r.batch_id: r.base for r in scores.combined(rows.filter("shard = 0"), given, "batch_id").collect()}
    assert {r.batch_id: r.base for r in got.filter("shard = 0").collect()} == one


def test_loss_gaps(spark):
    rows = made(spark, [r"\boxed{7}", r"\boxed{1 2}", r"\boxed{3}", r"\boxed{4}"])
    given = constant_losses(rows, 0.5)
    assert scores.loss_gaps(rows, given).isEmpty()
    cut = given.filter("NOT (example_id = 0 AND i = 2) AND example_id <> 3")
    cut = cut.unionByName(given.filter("example_id = 1 AND i IN (1, 3)"))
    cut = cut.withColumn("loss", F.expr("CASE WHEN example_id = 2 AND i = 1 THEN NULL ELSE loss END"))
    n_tok = {r.example_id: r.n_tok for r in rows.collect()}
    got = {r.example_id: tuple(r)[1:] for r in scores.loss_gaps(rows, cut).collect()}
    assert got == {
        0: (n_tok[0] - 1, 1, 0, 0),
        1: (n_tok[1] - 1, 0, 2, 0),
        2: (n_tok[2] - 1, 0, 0, 1),
        3: (n_tok[3] - 1, n_tok[3] - 1, 0, 0),
    }

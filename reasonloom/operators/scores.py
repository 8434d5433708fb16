"""Example and batch scores from token losses.

Input: `examples` of `build_examples` and a table (example_id, i, loss), with
the loss of predicting token i. Position 0 is never predicted and never counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.functions import losses as L
from reasonloom.functions.text import TAGS
from reasonloom.operators.examples import in_answer, in_target

By = str | tuple[str, ...] | list[str]

POSITIONS = ("n_tok", "target_start", "answer_lo", "answer_hi")


@dataclass(frozen=True)
class ScoreConfig:
    # The defaults that training uses.
    marker_weight: float = 10.0
    efficiency_weight: float = 0.1
    efficiency_threshold: float = 0.5
    efficiency_reward: float = 0.1
    efficiency_penalty: float = 0.1
    repetition_weight: float = 0.05
    repetition_n: int = 4
    repetition_coeff: float = 1.0


def _names(by: By) -> tuple[str, ...]:
    """The columns that name a batch, such as ("shard", "batch_id")."""
    return (by,) if isinstance(by, str) else tuple(by)


def token_weight(cfg: ScoreConfig = ScoreConfig()) -> Column:
    """Weight of a scored token: the marker weight on target tags, 1 on targets, else 0."""
    weight = F.when(F.array_contains("tags", F.col("i")), cfg.marker_weight).otherwise(1.0)
    return F.when(F.col("target"), weight).otherwise(0.0)


def score_tokens(
    examples: DataFrame,
    losses: DataFrame,
    carry: tuple[str, ...] = (),
    cfg: ScoreConfig = ScoreConfig(),
    key: str = "example_id",
) -> DataFrame:
    """(key, carry..., i, loss, weight, target, answer), one row per scored token.

    Only positions are joined to the losses, never token text: about 100 bytes
    per example. Spark broadcasts that side if it measures it as small; else
    both sides are shuffled by key, and a key has at most `max_length` rows.
    """
    tags = F.transform(
        F.filter(
            F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))),
            lambda x: x["t"].isin(*TAGS),
        ),
        lambda x: x["i"],
    )
    compact = examples.select(key, *carry, *POSITIONS, tags.alias("tags"))
    scored = losses.filter(F.col("i") >= 1).join(compact, key)
    marked = scored.withColumns(
        {"target": in_target(F.col("i")), "answer": in_answer(F.col("i"))}
    )
    return marked.select(
        key, *carry, "i", "loss", token_weight(cfg).alias("weight"), "target", "answer"
    )


def loss_gaps(examples: DataFrame, losses: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, n_expected, n_missing, n_repeated, n_null) of every example with such a gap.

    Positions 1 to n_tok - 1 are expected once each, with a loss that is not null. Scores use
    the losses there are, so a gap changes the mean: look here before trusting them.
    """
    wanted = examples.select(key, "n_tok")
    given = losses.join(wanted, key).filter((F.col("i") >= 1) & (F.col("i") < F.col("n_tok")))
    per_token = given.groupBy(key, "i").agg(
        F.count("*").alias("_n"), F.count_if(F.col("loss").isNull()).alias("_null")
    )
    per_example = per_token.groupBy(key).agg(
        F.count("*").alias("_seen"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"),
        F.sum("_null").alias("n_null"),
    )
    n_expected = F.greatest(F.col("n_tok") - 1, F.lit(0)).cast("long")
    report = wanted.join(per_example, key, "left").select(
        key,
        n_expected.alias("n_expected"),
        (n_expected - F.coalesce("_seen", F.lit(0))).alias("n_missing"),
        F.coalesce("n_repeated", F.lit(0)).cast("long").alias("n_repeated"),
        F.coalesce("n_null", F.lit(0)).cast("long").alias("n_null"),
    )
    return report.filter("n_missing > 0 OR n_repeated > 0 OR n_null > 0")


def base_loss(scored: DataFrame, by: By) -> DataFrame:
    """Weighted loss over the unweighted number of target tokens; 0 if there are none."""
    n = F.count_if("target")
    total = F.sum(F.col("loss") * F.col("weight"))
    return scored.groupBy(*_names(by)).agg(F.when(n > 0, total / n).otherwise(0.0).alias("base"))


def efficiency(
    scored: DataFrame, key: str = "example_id", cfg: ScoreConfig = ScoreConfig(), carry=()
) -> DataFrame:
    """(key, carry..., n_ans, score) of every example with an answer token."""
    used = scored.filter(is_answer())
    return (
        used.groupBy(key, *carry)
        .agg(F.count("*").alias("n_ans"), F.avg("loss").alias("_mean"))
        .select(key, *carry, "n_ans", _efficiency(F.col("n_ans"), F.col("_mean"), cfg).alias("score"))
    )


def is_answer() -> Column:
    return F.col("answer") & F.col("target")


def _answer_parts() -> list[Column]:
    """Per example, without dropping those that have no answer token."""
    return [
        F.count_if(is_answer()).alias("_n_ans"),
        F.avg(F.when(is_answer(), F.col("loss"))).alias("_mean"),
    ]


def _efficiency(n: Column, mean: Column, cfg: ScoreConfig) -> Column:
    return L.efficiency_score(
        n, mean, cfg.efficiency_threshold, cfg.efficiency_reward, cfg.efficiency_penalty
    )


def _mean_efficiency(cfg: ScoreConfig) -> Column:
    score = _efficiency(F.col("_n_ans"), F.col("_mean"), cfg)
    return F.coalesce(F.avg(F.when(F.col("_n_ans") > 0, score)), F.lit(0.0))


def efficiency_batch(
    scored: DataFrame, by: By, key: str = "example_id", cfg: ScoreConfig = ScoreConfig()
) -> DataFrame:
    """(by, eff): mean over the batch's examples with an answer token, 0 if there are none."""
    names = _names(by)
    per_example = scored.groupBy(key, *names).agg(*_answer_parts())
    return per_example.groupBy(*names).agg(_mean_efficiency(cfg).alias("eff"))


def _first_think() -> Column:
    return F.greatest(F.col("think_open") + 1, F.lit(1))


def _n_think() -> Column:
    return F.col("think_close") - _first_think()


def _repetition_rows(examples: DataFrame, cfg: ScoreConfig, *cols: str) -> DataFrame:
    """Score of every example, null where it has too few think tokens.

    Row-wise: the think tokens of one example are at most `max_length`.
    """
    think = F.when(
        _n_think() > cfg.repetition_n, F.slice("tokens", _first_think() + 1, _n_think())
    )
    n_grams = F.size("_grams")
    score = F.lit(0.0)
    if cfg.repetition_coeff > 0:
        score = L.repetition_score(F.col("_grams"), cfg.repetition_coeff)
    return (
        examples.select(*cols, think.alias("_think"))
        .select(*cols, L.ngrams(F.col("_think"), cfg.repetition_n).alias("_grams"))
        .select(
            *cols,
            n_grams.cast("long").alias("n_grams"),
            F.when(n_grams > 0, score).alias("score"),
        )
    )


def repetition(
    examples: DataFrame, key: str = "example_id", cfg: ScoreConfig = ScoreConfig(), carry=()
) -> DataFrame:
    """(key, carry..., n_grams, score) of every example with more than n think tokens."""
    long_enough = examples.filter(_n_think() > cfg.repetition_n)
    return _repetition_rows(long_enough, cfg, key, *carry)


def repetition_batch(
    examples: DataFrame, by: By, cfg: ScoreConfig = ScoreConfig()
) -> DataFrame:
    """(by, rep): mean over the batch's long enough examples, 0 if there are none."""
    mean = F.coalesce(F.avg("score"), F.lit(0.0))
    names = _names(by)
    return _repetition_rows(examples, cfg, *names).groupBy(*names).agg(mean.alias("rep"))


def combined(
    examples: DataFrame,
    losses: DataFrame,
    by: By,
    cfg: ScoreConfig = ScoreConfig(),
    key: str = "example_id",
) -> DataFrame:
    """(by, base, eff, rep, total) in one pass over the losses.

    The token losses are added up per example, then per batch; each step adds up
    before its shuffle, so a batch of any size is fine. A part whose weight is 0
    is not computed and counts as 0.
    """
    names = _names(by)
    scored = score_tokens(examples, losses, names, cfg, key)
    per_example = scored.groupBy(key, *names).agg(
        F.sum(F.col("loss") * F.col("weight")).alias("_loss"),
        F.count_if("target").alias("_n"),
        *_answer_parts(),
    )
    eff = _mean_efficiency(cfg) if cfg.efficiency_weight > 0 else F.lit(0.0)
    base = F.when(F.sum("_n") > 0, F.sum("_loss") / F.sum("_n")).otherwise(0.0)
    parts = per_example.groupBy(*names).agg(base.alias("base"), eff.alias("eff"))
    if cfg.repetition_weight > 0:
        means = repetition_batch(examples, names, cfg)
        parts = parts.join(means, list(names), "full").fillna(0.0, ["base", "eff", "rep"])
    else:
        parts = parts.withColumn("rep", F.lit(0.0))
    total = (
        F.col("base")
        + cfg.efficiency_weight * F.col("eff")
        + cfg.repetition_weight * F.col("rep")
    )
    return parts.select(*names, "base", "eff", "rep", total.alias("total"))

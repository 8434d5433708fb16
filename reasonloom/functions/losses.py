"""Column expressions for token losses and example scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once.

    An expression used inside a lambda is computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def token_ce(logits: Column | str, label: Column | str) -> Column:
    """Cross-entropy of one token, -log softmax(logits)[label], by stable log-sum-exp.

    A label outside the array gives null.
    """
    logits = F.col(logits) if isinstance(logits, str) else logits
    label = F.col(label) if isinstance(label, str) else label

    def log_sum(x: Column) -> Column:
        shares = F.aggregate(
            x["all"], F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - x["top"])
        )
        return x["top"] + F.log(shares)

    scaled = F.struct(logits.alias("all"), F.array_max(logits).cast("double").alias("top"))
    return bound(scaled, log_sum) - F.get(logits, label).cast("double")


def chunk_sums(logits: Column | str) -> Column:
    """(top, total) of a chunk of logits: its maximum and the sum of exp(logit - maximum).

    Null for an empty or null chunk. Two such pairs merge without the logits: the greater maximum,
    and both sums scaled to it.
    """
    logits = F.col(logits) if isinstance(logits, str) else logits

    def sums(x: Column) -> Column:
        total = F.aggregate(
            x["all"], F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - x["top"])
        )
        return F.when(x["top"].isNotNull(), F.struct(x["top"].alias("top"), total.alias("total")))

    return bound(F.struct(logits.alias("all"), F.array_max(logits).cast("double").alias("top")), sums)


def sigmoid(col: Column) -> Column:
    return 1 / (1 + F.exp(-col))


def efficiency_score(
    n_answer: Column, mean_loss: Column, threshold: float, reward: float, penalty: float
) -> Column:
    """Small for a short answer of low loss, large for a long answer of high loss."""
    wrong = sigmoid(mean_loss - threshold)
    return -reward * (1 / (n_answer + 1e-6)) * (1 - wrong) + penalty * n_answer * wrong


def ngrams(tokens: Column, n: int) -> Column:
    """Every run of n tokens as one string.

    Each token carries its length, so two different runs never give the same
    string. Strings, unlike arrays, are hashed when made distinct.
    """
    marked = F.transform(tokens, lambda t: F.concat(F.length(t).cast("string"), F.lit(":"), t))

    def runs(x: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(x) - n)
        run = F.transform(starts, lambda k: F.concat(*[F.get(x, k + j) for j in range(n)]))
        return F.when(F.size(x) >= n, run).otherwise(F.array().cast("array<string>"))

    return bound(marked, runs)


def repetition_score(grams: Column, coeff: float) -> Column:
    """Share of runs that repeat an earlier run."""
    n_grams = F.size(grams)
    return F.lit(float(coeff)) * (n_grams - F.size(F.array_distinct(grams))) / n_grams

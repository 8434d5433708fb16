"""Training examples: prompt, tokens, masks and the reason for every dropped row.

Everything here is a row-wise column expression, so building examples needs no
shuffle. Each mask is one run of neighbouring tokens, kept as two numbers; the
fixed-length arrays are made from them at the end, by `example_arrays`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from reasonloom.functions import text as T
from reasonloom.functions.tokenizers import BatchTokenizer, Tokenizer, batch_count, batch_spans
from reasonloom.session import computed_once

PAD = "<pad>"
# Fixed value: the instruction that training puts before every question.
DEFAULT_SYSTEM_PROMPT = (
    "You are an AI assistant. Your primary task is to solve the given mathematical problem.\n"
    "First, think step-by-step to break down the problem, outline your reasoning, and perform "
    "necessary calculations. Enclose your entire thought process within <think> and </think> "
    "tags.\n"
    "After your thought process, clearly state the final answer. The final answer must be "
    "enclosed within \\boxed{}. For example: <think>This is step 1... This is step 2... Thus "
    "the answer is X.</think>The final answer is \\boxed{X}."
)
SPANS = "array<struct<token: string, s: int, e: int>>"


EXAMPLE_COLUMNS = (
    "tokens",
    "n_tok",
    "target_start",
    "n_tgt",
    "think_open",
    "think_close",
    "n_think",
    "answer_lo",
    "answer_hi",
    "n_ans",
    "think_status",
    "status",
)


# From these and the tokens, every array of an example follows.
POSITION_COLUMNS = (
    "n_tok",
    "target_start",
    "think_open",
    "think_close",
    "answer_lo",
    "answer_hi",
)


@dataclass(frozen=True)
class ExampleConfig:
    """`tokenizer` replaces the built-in one: text -> (token, start, end), in text order, or a
    `BatchTokenizer`, which is several times cheaper.

    It may add special tokens, of empty spans, to every text it gets; `bos_token` names the one it
    puts first, which then counts before the target. Prompts are measured without them.
    """

    max_length: int = 1024
    system_prompt: str | None = None
    tokenizer: Tokenizer | BatchTokenizer | None = None
    bos_token: str | None = None

    def __post_init__(self) -> None:
        if self.max_length <= 0:
            raise ValueError("max_length must be positive")


def prompt_text(problem: Column, system_prompt: str | None) -> Column:
    head = f"{system_prompt}\n" if system_prompt else ""
    return F.concat(F.lit(f"{head}Question: "), T.text_or_empty(problem), F.lit("\n"))


def render_prompt(df: DataFrame, system_prompt: str | None = None) -> DataFrame:
    """Add `prompt` and `full_text`, the prompt followed by the solution."""
    prompt = prompt_text(F.col("problem"), system_prompt)
    return df.withColumn("prompt", prompt).withColumn(
        "full_text", F.concat("prompt", T.text_or_empty("generated_solution"))
    )


def spans_udf(tokenizer: Tokenizer | BatchTokenizer, most: int) -> Callable[[Column], Column]:
    """The first `most` spans of a text; what lies beyond does not leave the Python worker."""
    if isinstance(tokenizer, BatchTokenizer):
        return batch_spans(tokenizer, most)

    @pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda text: [
                    dict(zip(("token", "s", "e"), span)) for span in tokenizer(text)[:most]
                ]
            )

    return spans


def count_udf(
    tokenizer: Tokenizer | BatchTokenizer, bos_token: str | None
) -> Callable[[Column], Column]:
    """How many tokens a text has without special ones: those of no text, and a first BOS."""
    if isinstance(tokenizer, BatchTokenizer):
        return batch_count(tokenizer)

    @pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda text: sum(
                    e > s and not (k == 0 and token == bos_token)
                    for k, (token, s, e) in enumerate(tokenizer(text))
                )
            ).astype("int32")

    return count


def _tokens_by_section(df: DataFrame) -> DataFrame:
    """Tokenize prompt, text before, inside and after the boxed answer one by one.

    The prompt ends in a newline and both braces of the box are tokens of their
    own, so no token crosses a border: the sections together give the tokens of
    the full text, and their sizes say where the answer lies. No character
    offsets are needed.
    """
    box = T.with_boxed_answer(df, "_solution")
    cut = box.withColumns(
        {
            "_before": F.when(
                F.col("has_box"), F.substring(F.col("_solution"), F.lit(1), F.col("c0"))
            ).otherwise(F.col("_solution")),
            "_after": F.when(
                F.col("has_box"),
                F.substring(F.col("_solution"), F.col("c1") + 1, F.length("_solution")),
            ).otherwise(F.lit("")),
        }
    )
    split = cut.withColumns(
        {
            "_p": T.tokens(F.col("_prompt")),
            "_b": T.tokens(F.col("_before")),
            "_a": T.tokens(T.text_or_empty("answer")),
            "_z": T.tokens(F.col("_after")),
        }
    )
    return split.withColumns(
        {
            "_all": F.concat("_p", "_b", "_a", "_z"),
            "target_start": F.size("_p"),
            "_lo": F.size("_p") + F.size("_b"),
            "_n_answer": F.size("_a"),
        }
    )


def _tokens_by_spans(df: DataFrame, cfg: ExampleConfig) -> DataFrame:
    """The caller's tokenizer: the answer tokens are those whose span lies in the box."""
    spans = spans_udf(cfg.tokenizer, cfg.max_length)
    count = count_udf(cfg.tokenizer, cfg.bos_token)
    full = F.concat("_prompt", "_solution")
    cut = T.with_boxed_answer(df, "_solution").withColumns(
        {"_spans": spans(full), "_n_prompt": count(F.col("_prompt"))}
    )
    bos = F.lit(0)
    if cfg.bos_token is not None:
        first = F.get(F.col("_spans"), 0)["token"]
        bos = F.when(first == cfg.bos_token, 1).otherwise(0)
    placed = cut.withColumns(
        {
            "target_start": F.col("_n_prompt") + bos,
            "_c0": F.length("_prompt") + F.col("c0"),
            "_c1": F.length("_prompt") + F.col("c1"),
        }
    )
    inside = F.transform(
        "_spans",
        lambda x, i: F.coalesce(
            (i >= F.col("target_start"))
            & (x["e"] > 0)
            & (x["s"] >= F.col("_c0"))
            & (x["e"] <= F.col("_c1")),
            F.lit(False),
        ),
    )
    return placed.withColumn("_in", inside).withColumns(
        {
            "_all": F.transform("_spans", lambda x: x["token"]),
            "_lo": F.greatest(F.array_position("_in", True).cast("int") - 1, F.lit(0)),
            "_n_answer": F.size(F.filter("_in", lambda x: x)),
        }
    )


def build_examples(df: DataFrame, cfg: ExampleConfig = ExampleConfig()) -> DataFrame:
    """Add tokens, token positions and a status to every row; no row is removed.

    The new columns are EXAMPLE_COLUMNS. `tokens` holds at most `max_length`
    entries, `answer_hi` is exclusive, and the think positions are null where
    the tag is missing.
    """
    base = df.withColumns(
        {
            "_prompt": prompt_text(F.col("problem"), cfg.system_prompt),
            "_solution": T.text_or_empty("generated_solution"),
        }
    )
    made = _tokens_by_spans(base, cfg) if cfg.tokenizer else _tokens_by_section(base)
    kept = made.withColumn("tokens", F.slice("_all", 1, cfg.max_length)).withColumns(
        {
            "n_tok": F.size("tokens"),
            "_target": F.slice("tokens", F.col("target_start") + 1, cfg.max_length),
        }
    )
    tags = kept.withColumn("_open", F.array_position("_target", T.THINK_OPEN).cast("int"))
    tags = tags.withColumn(
        "_close",
        F.array_position(
            F.slice("_target", F.col("_open") + 1, cfg.max_length), T.THINK_CLOSE
        ).cast("int"),
    )
    opened, closed = F.col("_open") > 0, F.col("_close") > 0
    placed = tags.withColumns(
        {
            "n_tgt": F.size("_target"),
            "think_open": F.when(opened, F.col("target_start") + F.col("_open") - 1),
            "think_close": F.when(
                opened & closed, F.col("target_start") + F.col("_open") - 1 + F.col("_close")
            ),
            "n_think": F.when(opened & closed, F.col("_close") - 1).otherwise(0),
            "think_status": F.when(opened & ~closed, "think_unclosed")
            .when(~opened & closed, "think_orphan_end")
            .otherwise("ok"),
            "answer_lo": F.least("_lo", "n_tok"),
            "answer_hi": F.least(F.col("_lo") + F.col("_n_answer"), "n_tok"),
        }
    ).withColumn("n_ans", F.col("answer_hi") - F.col("answer_lo"))
    status = (
        F.when(~F.col("has_box"), "no_boxed")
        .when(F.col("think_status") != "ok", F.col("think_status"))
        .when(F.col("n_ans") == 0, "answer_unmapped")
        .otherwise("ok")
    )
    done = placed.withColumn("status", status).select(*df.columns, *EXAMPLE_COLUMNS)
    return computed_once(done, *EXAMPLE_COLUMNS)


def example_report(examples: DataFrame) -> DataFrame:
    """Number of rows per status."""
    return examples.groupBy("status").agg(F.count("*").alias("n"))


def in_target(i: Column) -> Column:
    return (i >= F.col("target_start")) & (i < F.col("n_tok"))


def in_think(i: Column) -> Column:
    inside = (i > F.col("think_open")) & (i < F.col("think_close"))
    return F.coalesce(inside, F.lit(False))


def in_answer(i: Column) -> Column:
    return (i >= F.col("answer_lo")) & (i < F.col("answer_hi"))


MASKS = {"loss_mask": in_target, "think_mask": in_think, "answer_mask": in_answer}


def mask_rows(examples: DataFrame, mask: str, key: str = "example_id") -> DataFrame:
    """One row (key, i, mask) per kept token."""
    positions = examples.select(
        key,
        *POSITION_COLUMNS,
        F.explode(F.when(F.col("n_tok") > 0, F.sequence(F.lit(0), F.col("n_tok") - 1))).alias("i"),
    )
    return positions.select(key, "i", MASKS[mask](F.col("i")).alias("mask"))


def pad_truncate(values: Column, length: int, pad) -> Column:
    """Cut or fill on the right to exactly `length` entries."""
    kept = F.slice(values, 1, length)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.lit(length) - F.size(kept)))


def run_mask(start: Column, end: Column, length: int, outside=False, inside=True) -> Column:
    """Array of `length` entries that are `inside` in [start, end) and `outside` elsewhere."""
    return F.concat(
        F.array_repeat(F.lit(outside), start),
        F.array_repeat(F.lit(inside), end - start),
        F.array_repeat(F.lit(outside), F.lit(length) - end),
    )


def shifted(values: Column) -> Column:
    """Drop position 0: what stands at i is predicted from i - 1."""
    return F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))


def array_columns(field: Callable[[str], Column], length: int, ids: str) -> dict[str, Column]:
    """The fixed-length arrays of one example; `field` gives its columns by name."""
    n_tok, closed = field("n_tok"), field("think_close")
    after_open = F.when(closed.isNotNull(), field("think_open") + 1).otherwise(0)
    filled = pad_truncate(field(ids), length, PAD if ids == "tokens" else 0)
    return {
        "input_ids": filled,
        "attention_mask": run_mask(F.lit(0), n_tok, length, 0, 1),
        "labels": filled,
        "loss_mask": run_mask(F.least(field("target_start"), n_tok), n_tok, length, 0, 1),
        "answer_mask": run_mask(field("answer_lo"), field("answer_hi"), length),
        "think_mask": run_mask(after_open, F.coalesce(closed, F.lit(0)), length),
    }


def example_arrays(examples: DataFrame, cfg: ExampleConfig, ids: str = "tokens") -> DataFrame:
    """Add the fixed-length arrays of a training example.

    `ids` names the column of token ids (see `vocab.encode_examples`); without
    one, the token strings stand for themselves.
    """
    return examples.withColumns(array_columns(F.col, cfg.max_length, ids))

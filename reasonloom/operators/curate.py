"""Curation: keep rows with an answer, a high pass rate and a bounded length."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.functions.text import to_number, token_count, word_count_bound
from reasonloom.functions.tokenizers import BatchTokenizer
from reasonloom.sources.readers import ABSENT, only_below, read_differing
from reasonloom.sources.sink import write_filtered

NO_ANSWER = "no_answer_extracted"  # fixed value
TYPE, RATE = "problem_type", "pass_rate_72b_tir"
TEXTS = ("problem", "generated_solution")


@dataclass(frozen=True)
class CurateConfig:
    max_len: int = 2048
    pass_rate: float = 0.8
    tokenizer: str | Callable[[str], int] | BatchTokenizer = "whitespace"

    def __post_init__(self) -> None:
        if self.max_len <= 0:
            raise ValueError("max_len must be positive")
        if not 0 <= self.pass_rate <= 1:
            raise ValueError("pass_rate must lie between 0 and 1")


def _absent(df: DataFrame, name: str) -> Column:
    """Whether a row's file does not have a column; false where nothing is known of files."""
    return F.array_contains(ABSENT, name) if ABSENT in df.columns else F.lit(False)


def has_answer() -> Column:
    return F.col(TYPE) != NO_ANSWER


def high_pass_rate(threshold: float) -> Column:
    return to_number(F.col(RATE)) > threshold


def combined_length(cfg: CurateConfig) -> Column:
    first, second = (token_count(c, cfg.tokenizer) for c in TEXTS)
    return first + second


def short_enough(cfg: CurateConfig) -> Column:
    """Length test; texts too short in bytes to be too long in words are not split."""
    exact = combined_length(cfg) <= cfg.max_len
    if cfg.tokenizer != "whitespace":
        return exact
    first, second = (word_count_bound(c) for c in TEXTS)
    return (first + second <= cfg.max_len) | exact


def _steps(df: DataFrame, cfg: CurateConfig) -> list[Column]:
    """The conditions that apply. A step whose column is absent keeps every row."""
    if TYPE not in df.columns:
        raise ValueError(f"the corpus has no column {TYPE}")
    steps = [has_answer()]
    if RATE in df.columns:
        steps.append(_absent(df, RATE) | high_pass_rate(cfg.pass_rate))
    else:
        steps.append(F.lit(True))
    if all(c in df.columns for c in TEXTS):
        steps.append(_absent(df, TEXTS[0]) | _absent(df, TEXTS[1]) | short_enough(cfg))
    else:
        steps.append(F.lit(True))
    return steps


def drop_no_answer(df: DataFrame) -> DataFrame:
    return df.filter(has_answer())


def filter_pass_rate(df: DataFrame, threshold: float = 0.8) -> DataFrame:
    return df.filter(high_pass_rate(threshold))


def filter_length(
    df: DataFrame,
    max_len: int = 2048,
    tokenizer: str | Callable[[str], int] | BatchTokenizer = "whitespace",
) -> DataFrame:
    return df.filter(short_enough(CurateConfig(max_len=max_len, tokenizer=tokenizer)))


def curate(df: DataFrame, cfg: CurateConfig = CurateConfig()) -> DataFrame:
    """All steps, cheapest first, without a shuffle. Columns stay as they are."""
    for step in _steps(df, cfg):
        df = df.filter(step)
    return df


def funnel(df: DataFrame, cfg: CurateConfig = CurateConfig(), by: str = "source_file") -> DataFrame:
    """(by, n0, n1, n2, n3): rows at first and after each step, in one pass."""
    answer, rate, length = _steps(df, cfg)
    return df.groupBy(by).agg(
        F.count("*").alias("n0"),
        F.count_if(answer).alias("n1"),
        F.count_if(answer & rate).alias("n2"),
        F.count_if(answer & rate & length).alias("n3"),
    )


def read_files(spark: SparkSession, root: str, skip_corrupt: bool = False) -> DataFrame:
    """Corpus files below `root` whose columns and types may differ, with `source_file`.

    `_absent` lists the columns that a row's file does not have, so that the steps on them keep
    the row, whatever the column's type elsewhere.
    """
    return read_differing(spark, root, only_below(spark, root), skip_corrupt)


def curate_files(
    spark: SparkSession,
    root: str,
    out: str,
    cfg: CurateConfig = CurateConfig(),
    skip_corrupt: bool = False,
) -> None:
    """Read every file below `root`, curate, and write one folder per source file."""
    write_filtered(curate(read_files(spark, root, skip_corrupt), cfg).drop(ABSENT), out)

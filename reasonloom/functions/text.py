"""Column expressions on text: numbers, words, tokens, boxed answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType

from reasonloom.functions.tokenizers import BatchTokenizer, batch_count

# Python's str.split() whitespace, as the inside of a regex class.
WHITESPACE = (
    r"\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The marker tags, always one token each.
THINK_OPEN = "<think>"
THINK_CLOSE = "</think>"
ANSWER_OPEN = "<answer>"
ANSWER_CLOSE = "</answer>"
TAGS = (THINK_OPEN, THINK_CLOSE, ANSWER_OPEN, ANSWER_CLOSE)
# Fixed value: spellings that count as numbers; unlike $, \z does not allow a newline.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\z"
BOX_OPEN = "\\boxed{"
BOX_CLOSE = "}"

# Only a tag and a single "<" can start on the same character, so the word run,
# by far the most common, is tried first. The look-ahead is about twice as fast
# in Java as the negated class.
TOKEN_PATTERN = rf"(?s)[\p{{L}}\p{{N}}]++|</?think>|</?answer>|(?![{WHITESPACE}])."
PIECE_PATTERN = rf"(?s)[\p{{L}}\p{{N}}]++|[{WHITESPACE}]++|</?think>|</?answer>|."


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def to_number(col: Column | str) -> Column:
    """Lenient cast to double: anything that is not a plain number becomes null."""
    col = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.when(col.rlike(NUMBER), col.try_cast("double"))


def word_count(col: Column | str) -> Column:
    """Number of whitespace-separated words; null counts as empty text.

    Splitting on the whitespace runs leaves an empty piece only at either end.
    It is several times faster than counting runs of the negated class.
    """
    return F.size(F.array_remove(F.split(text_or_empty(col), f"[{WHITESPACE}]+"), "")).cast("long")


def word_count_bound(col: Column | str) -> Column:
    """Upper bound of word_count in constant time: a word and its gap take two bytes."""
    return F.floor((F.octet_length(text_or_empty(col)) + 1) / 2)


def counter_udf(count: Callable[[str], int]) -> Callable[[Column], Column]:
    """Wrap a caller's token counter so that Spark feeds it Arrow batches."""

    @pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(count)

    return counted


def token_count(
    col: Column | str, tokenizer: str | Callable[[str], int] | BatchTokenizer = "whitespace"
) -> Column:
    if tokenizer == "whitespace":
        return word_count(col)
    if isinstance(tokenizer, BatchTokenizer):
        return batch_count(tokenizer)(text_or_empty(col))
    return counter_udf(tokenizer)(text_or_empty(col))


def tokens(col: Column) -> Column:
    """Tokens in text order: tags, letter-or-digit runs, single other characters."""
    return F.regexp_extract_all(col, F.lit(TOKEN_PATTERN), F.lit(0))


def pieces(col: Column) -> Column:
    """Tokens and the whitespace between them; together they are the whole text."""
    return F.regexp_extract_all(col, F.lit(PIECE_PATTERN), F.lit(0))


def is_blank(col: Column) -> Column:
    """True for a whitespace piece; a piece is blank as soon as its first character is."""
    return col.rlike(f"^[{WHITESPACE}]")


def running_ends(lengths: Column) -> Column:
    """Running total inside each list of an array<int> column.

    Built-in array functions copy the list for every step, and a window would
    shuffle every token. One cumulative sum over a whole Arrow batch does neither.
    """

    # Inside a function, so that it travels to the workers by value.
    @arrow_udf(ArrayType(IntegerType()))
    def totals(lists: pa.Array) -> pa.Array:
        bounds = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        total = np.concatenate(([0], np.cumsum(flat, dtype=np.int64)))
        ends = total[1:] - np.repeat(total[bounds[:-1]], np.diff(bounds))
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ends, pa.int32()))

    return totals(lengths)


def with_boxed_answer(df: DataFrame, col: str) -> DataFrame:
    """Add the first boxed answer: `has_box`, `answer`, `c0`, `c1`.

    [c0, c1) is the content in characters. It ends at the first closing brace,
    so two substring searches find it; braces are not balanced. Without an
    answer the other columns are null.
    """
    found = df.withColumn("_text", text_or_empty(col)).withColumn("_at", F.instr("_text", BOX_OPEN))
    ended = found.withColumn("_from", F.col("_at") + len(BOX_OPEN)).withColumn(
        "_end",
        F.when(
            F.col("_at") > 0,
            F.call_function("locate", F.lit(BOX_CLOSE), F.col("_text"), F.col("_from")),
        ).otherwise(0),
    )
    has = F.col("_end") > 0
    return ended.withColumns(
        {
            "has_box": has,
            "answer": F.when(
                has, F.substring(F.col("_text"), F.col("_from"), F.col("_end") - F.col("_from"))
            ),
            "c0": F.when(has, F.col("_from") - 1),
            "c1": F.when(has, F.col("_end") - 1),
        }
    ).drop("_text", "_at", "_from", "_end")


def split_path(col: Column | str) -> tuple[Column, Column]:
    """(folder, name): everything before the last slash, and what follows it."""
    parts = F.split(F.col(col) if isinstance(col, str) else col, "/")
    return (
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
        F.element_at(parts, -1),
    )

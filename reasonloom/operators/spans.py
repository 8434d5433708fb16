"""Tokens with character spans, one row per token."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reasonloom.functions import text as T
from reasonloom.functions.tokenizers import BatchTokenizer, Tokenizer
from reasonloom.operators.examples import spans_udf
from reasonloom.session import computed_once

ALL = 2**31 - 1


def token_spans(
    df: DataFrame,
    col: str,
    key: str = "example_id",
    max_length: int | None = None,
    tokenizer: Tokenizer | BatchTokenizer | None = None,
) -> DataFrame:
    """(key, i, token, s, e): token i covers characters [s, e) of the text.

    The pieces tile the text, so the running total of their lengths gives the
    spans. Only the lengths leave the JVM. Without `max_length` every token of
    the text is returned. A null text has no tokens.
    """
    text = T.text_or_empty(col)
    if tokenizer:
        spans = df.select(key, spans_udf(tokenizer, max_length or ALL)(text).alias("spans"))
    else:
        tiled = df.select(key, T.pieces(text).alias("pieces"))
        if max_length is not None:
            # At most one blank piece stands before each token.
            tiled = tiled.withColumn("pieces", F.slice("pieces", 1, 2 * max_length))
        ended = tiled.withColumn("ends", T.running_ends(F.transform("pieces", F.length)))
        zipped = F.arrays_zip(F.col("pieces").alias("token"), F.col("ends").alias("e"))
        spans = ended.select(
            key,
            F.transform(
                F.filter(zipped, lambda x: ~T.is_blank(x["token"])),
                lambda x: F.struct(
                    x["token"].alias("token"),
                    (x["e"] - F.length(x["token"])).alias("s"),
                    x["e"].alias("e"),
                ),
            ).alias("spans"),
        )
    if max_length is not None:
        spans = spans.withColumn("spans", F.slice("spans", 1, max_length))
    rows = computed_once(spans, "spans").select(key, F.posexplode("spans").alias("i", "x"))
    return rows.select(key, "i", "x.token", "x.s", "x.e")

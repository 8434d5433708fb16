"""Token losses over a real vocabulary: the logits of a position come in chunks.

A vocabulary of 150,000 logits is over a megabyte a position, too much to shuffle or to hold for
many positions. So each chunk is summed up where it is read, to two numbers; only these are
shuffled, and merged as running maximum and scaled sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reasonloom.functions.losses import chunk_sums

By = str | tuple[str, ...] | list[str]


def _names(by: By) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def chunked_ce(
    chunks: DataFrame,
    by: By,
    logits: str = "logits",
    first: str = "first_id",
    label: str = "label",
) -> DataFrame:
    """(by..., ce, n_ids): the cross-entropy of each position, and how many logits it has.

    A row of `chunks` holds the logits of the ids from `first` on, with the position's label. The
    order and the sizes of chunks do not matter. A position whose label lies in no chunk (null, or
    an ignored label such as -100) has a null loss; empty and null chunks count for nothing. Chunks
    given twice count twice: see `logit_gaps`. One shuffle of four numbers a chunk.
    """
    names = _names(by)
    place = (F.col(label) - F.col(first)).cast("int")
    summed = chunks.select(
        *names,
        chunk_sums(logits).alias("part"),
        F.when(place >= 0, F.get(F.col(logits), place)).cast("double").alias("own"),
        F.greatest(F.size(logits), F.lit(0)).cast("long").alias("n_ids"),
    )
    parts = summed.select(*names, "part.top", "part.total", "own", "n_ids")
    most = F.max("top").over(Window.partitionBy(*names))
    # a chunk of logits that are all minus infinity adds nothing
    none = F.col("top") == float("-inf")
    scaled = F.when(none, 0.0).otherwise(F.col("total") * F.exp(F.col("top") - F.col("most")))
    sums = parts.withColumn("most", most).withColumn("scaled", scaled)
    merged = sums.groupBy(*names).agg(
        F.max("most").alias("most"),
        F.sum("scaled").alias("total"),
        F.max("own").alias("own"),
        F.sum("n_ids").alias("n_ids"),
    )
    ce = F.col("most") + F.log("total") - F.col("own")
    return merged.select(*names, ce.alias("ce"), "n_ids")


def logit_gaps(
    chunks: DataFrame, by: By, n_ids: int, logits: str = "logits", first: str = "first_id"
) -> DataFrame:
    """(by..., n_chunks, n_ids) of positions whose chunks do not cover ids 0 to `n_ids` - 1 once each."""
    names = _names(by)
    size = F.greatest(F.size(logits), F.lit(0)).cast("long")
    end = F.col(first) + size
    starts = chunks.filter(size > 0).select(*names, F.col(first).alias("first"), end.alias("end"))
    before = F.lag("end", 1, 0).over(Window.partitionBy(*names).orderBy("first"))
    joined = starts.withColumn("joins", F.col("first") == before)
    found = joined.groupBy(*names).agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.col("end") - F.col("first")).alias("n_ids"),
        (F.bool_and("joins") & (F.max("end") == n_ids)).alias("whole"),
    )
    return found.filter(~F.col("whole")).drop("whole")

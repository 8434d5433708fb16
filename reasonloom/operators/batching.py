"""Shards and batches of a shuffled set of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.operators.examples import POSITION_COLUMNS, ExampleConfig, array_columns
from reasonloom.operators.ordering import shuffle_rows


def assign_shards(
    df: DataFrame,
    n: int,
    seed: int,
    epoch: int = 0,
    key: str = "example_id",
    pad: bool = False,
) -> DataFrame:
    """Shard r takes positions r, r + n, ... of the epoch's shuffle.

    Adds `shard` and `slot`, the row's place inside its shard. With `pad` the
    first rows of the order are repeated until all shards have the same size.
    """
    if n <= 0:
        raise ValueError("the number of shards must be positive")
    placed = shuffle_rows(df, seed, epoch, key, "_pos")
    if pad:
        total = df.count()
        missing = -total % n
        if missing:
            first_copy = F.col("_pos") + total
            copies = F.sequence(first_copy, F.lit(total + missing - 1), F.lit(total))
            placed = placed.withColumn(
                "_at",
                F.explode(
                    F.when(
                        first_copy < total + missing, F.concat(F.array("_pos"), copies)
                    ).otherwise(F.array("_pos"))
                ),
            )
            placed = placed.drop("_pos").withColumnRenamed("_at", "_pos")
    return (
        placed.withColumn("shard", F.pmod("_pos", F.lit(n)).cast("long"))
        .withColumn("slot", F.floor(F.col("_pos") / n).cast("long"))
        .drop("_pos")
    )


def assign_batches(df: DataFrame, size: int) -> DataFrame:
    """Consecutive slots of a shard form a batch; a short last batch is kept."""
    if size <= 0:
        raise ValueError("the batch size must be positive")
    return df.withColumn("batch_id", F.floor(F.col("slot") / size).cast("long"))


def collate(df: DataFrame, cfg: ExampleConfig, ids: str = "tokens") -> DataFrame:
    """One row per batch with the stacked arrays of its usable examples.

    Batches are cut before unusable examples are dropped, so sizes vary and a
    batch without a usable example disappears. Tokens and positions are
    shuffled; the padded arrays are made from them afterwards. A group holds at
    most one batch.
    """
    member = F.struct("slot", ids, *POSITION_COLUMNS)
    batches = (
        df.filter(F.col("status") == "ok")
        .groupBy("shard", "batch_id")
        .agg(F.count("*").alias("n_kept"), F.sort_array(F.collect_list(member)).alias("_rows"))
    )

    def stacked(name: str) -> Column:
        return F.transform("_rows", lambda x: array_columns(x.getField, cfg.max_length, ids)[name])

    names = array_columns(F.col, cfg.max_length, ids)
    return batches.select("shard", "batch_id", "n_kept", *[stacked(n).alias(n) for n in names])

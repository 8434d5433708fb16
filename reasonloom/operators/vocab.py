"""Token ids from a frequency-ranked vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from reasonloom.functions.text import TAGS
from reasonloom.operators.examples import PAD
from reasonloom.operators.ordering import order_position
from reasonloom.session import write_once

# Fixed ids: the pad token, then the tags; ranked tokens follow.
RESERVED = (PAD, *TAGS)

# The part of the vocabulary that may be broadcast: at most 65,536 tokens of at
# most 1 KiB, so 64 MiB however large the data.
HEAD_IDS = 65_536
HEAD_BYTES = 1024


def token_rows(
    examples: DataFrame, key: str = "example_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    return examples.select(key, *carry, F.posexplode("tokens").alias("i", "token"))


BLOCK_TOKENS = 1 << 18


def token_blocks(
    examples: DataFrame, key: str = "example_id", carry: tuple[str, ...] = ()
) -> DataFrame:
    """The examples dictionary-encoded in blocks of about 2^18 tokens, written once.

    A block is one table of its distinct tokens, with rows (block, token, code, n), and rows (block,
    key, carry..., codes) for its examples. So a token is looked up once a block and not once an
    occurrence, and only numbers are shuffled for the examples. Blocks never cross a task.
    """
    names = [key, *carry]
    inner = examples.select(*names, F.col("tokens").cast("array<string>").alias("tokens"))
    out = inner.select(
        F.lit(0).cast("long").alias("block"),
        *names,
        F.lit(None).cast("array<int>").alias("codes"),
        F.lit(None).cast("string").alias("token"),
        F.lit(None).cast("int").alias("code"),
        F.lit(None).cast("long").alias("n"),
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            sizes = batch.column("tokens").value_lengths().fill_null(0).to_numpy()
            before = np.cumsum(sizes) - sizes
            cuts = np.flatnonzero(np.diff(before // BLOCK_TOKENS)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                lists = part.column("tokens")
                coded = lists.flatten().dictionary_encode()
                codes = coded.indices.cast(pa.int32())
                ends = np.concatenate([[0], np.cumsum(sizes[start:end])]).astype(np.int32)
                counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                n, words = part.num_rows, len(coded.dictionary)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, block)),
                        *(part.column(c) for c in names),
                        pa.ListArray.from_arrays(pa.array(ends), codes),
                        pa.nulls(n, pa.string()),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.int64()),
                    ],
                    ["block", *names, "codes", "token", "code", "n"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(words, block)),
                        *(pa.nulls(words, part.column(c).type) for c in names),
                        pa.nulls(words, pa.list_(pa.int32())),
                        coded.dictionary.cast(pa.string()),
                        pa.array(np.arange(words, dtype=np.int32)),
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["block", *names, "codes", "token", "code", "n"],
                )
                block += 1

    return write_once(inner.mapInArrow(encode, _nullable(out.schema)), "blocks")


def _nullable(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType) for f in schema])


def block_tokens(blocks: DataFrame) -> DataFrame:
    """(block, token, code, n): the distinct tokens of each block."""
    return blocks.filter("codes IS NULL").select("block", "token", "code", "n")


def encode_blocks(blocks: DataFrame, vocab: DataFrame) -> DataFrame:
    """(key, carry..., token_ids) of the examples of `token_blocks`.

    A token outside the vocabulary is left out. Ids go back to their places by block.
    """
    names = [c for c in blocks.columns if c not in ("block", "codes", "token", "code", "n")]
    coded = blocks.filter("codes IS NOT NULL").select("block", *names, "codes")
    found = join_vocab(block_tokens(blocks), vocab.select("token", "id"))
    ids = found.select(F.col("block").alias("of_block"), "code", "id")
    out = coded.select(*names, F.lit(None).cast("array<long>").alias("token_ids"))

    def put_back(rows: pa.Table, found: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        lists = rows.column("codes").combine_chunks()
        code, id_ = (found.column(c).to_numpy() for c in ("code", "id"))
        values = lists.flatten().to_numpy()
        size = 1 + max(values.max(initial=-1), code.max(initial=-1))
        of_code = np.full(size, -1, np.int64)
        of_code[code] = id_
        made = of_code[values]
        kept = made >= 0
        ends = np.cumsum(lists.value_lengths().to_numpy())
        ends = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
        arrays = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(made[kept]))
        return pa.Table.from_arrays([*(rows.column(c) for c in names), arrays], [*names, "token_ids"])

    both = coded.groupBy("block").cogroup(ids.groupBy("of_block"))
    return both.applyInArrow(put_back, _nullable(out.schema))


def build_vocab(tokens: DataFrame) -> DataFrame:
    """(token, n, id), ranked by count, then token. `tokens` has a column `token`.

    A row counts once, or `n` times if there is such a column (see `block_tokens`).

    Reserved tokens have fixed ids; n is null for those that never occur. The
    counts are added up before the shuffle, so a frequent token costs nothing
    extra. The result stands in the checkpoint folder and is cheap to reuse.
    """
    spark = tokens.sparkSession
    reserved = F.col("token").isin(*RESERVED)
    n = F.sum("n") if "n" in tokens.columns else F.count("*")
    counts = tokens.groupBy("token").agg(n.alias("n"))
    ranked = order_position(counts, [F.desc(reserved), F.desc("n"), F.asc("token")], "_rank")
    found = ranked.filter(reserved)  # at most five rows, ranked first
    shift = len(RESERVED) - found.count()
    rest = ranked.filter(~reserved).select("token", "n", (F.col("_rank") + shift).alias("id"))
    fixed = spark.createDataFrame(list(zip(RESERVED, range(len(RESERVED)))), "token string, id long")
    first = fixed.join(found, "token", "left").select("token", "n", "id")
    return rest.unionByName(first).checkpoint()


def in_head() -> Column:
    return (F.col("id") < HEAD_IDS) & (F.octet_length("token") <= HEAD_BYTES)


def join_vocab(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Inner join of `rows` to the vocabulary on `token`.

    Natural token counts are very uneven. The most frequent tokens go into a
    broadcast of bounded size and their rows are not shuffled. Only the rest,
    where no ordinary token has more than one in 65,536 of the rows, is shuffled.
    """
    head = vocab.filter(in_head())
    common = rows.join(F.broadcast(head), "token")
    tail = vocab.filter(~in_head())
    if tail.isEmpty():
        return common
    rare = rows.join(F.broadcast(head.select("token")), "token", "left_anti")
    # The optimizer does not see how many rows an explode makes,
    # so it is told not to broadcast either side.
    return common.unionByName(rare.join(tail.hint("merge"), "token"))


def join_counts(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Inner join of `rows` to (token, n, ...) on `token`, where `n` adds up to `total`.

    At most 65,536 tokens hold one in 65,536 of the rows or more, so those of at most 1 KiB are
    broadcast, whatever the data; rows of all others are shuffled. No ranking is needed.
    """
    common = (F.col("n") * HEAD_IDS >= total) & (F.octet_length("token") <= HEAD_BYTES)
    head, tail = counts.filter(common), counts.filter(~common)
    frequent = rows.join(F.broadcast(head), "token")
    rare = rows.join(F.broadcast(head.select("token")), "token", "left_anti")
    return frequent.unionByName(rare.join(tail.hint("merge"), "token"))


def encode(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace `token` by its `id`; a token outside the vocabulary is left out."""
    return join_vocab(rows, vocab.select("token", "id")).drop("token")


def encode_examples(
    examples: DataFrame,
    vocab: DataFrame,
    key: str = "example_id",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Add `token_ids`, one array per example of at most `max_length` entries.

    With `carry` the result has the key, these columns and the ids only, from one shuffle by block.
    Otherwise the ids are joined back to all columns. A token outside the vocabulary is left out.
    """
    ids = encode_blocks(token_blocks(examples, key, tuple(carry or ())), vocab)
    if carry is not None:
        return ids
    return examples.join(ids, key, "left").withColumn(
        "token_ids", F.coalesce("token_ids", F.array().cast("array<bigint>"))
    )

"""The registered queries: each runs one operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reasonloom.functions import text as T
from reasonloom.functions.losses import token_ce
from reasonloom.functions.tokenizers import BatchTokenizer
from reasonloom.operators import (
    batching,
    chat,
    curate,
    examples,
    logits,
    ordering,
    scores,
    spans,
    vocab,
)
from reasonloom.plans.reasoning import SYSTEM_PROMPT, reasoning
from reasonloom.session import scratch_path, write_once
from reasonloom.sources import copies, files, footers, paths, readers, sink

CFG = examples.ExampleConfig(max_length=1024, system_prompt=SYSTEM_PROMPT)
N_BATCHES = 50
SEED = 42
REQUIRED = ("problem", "generated_solution")
INCLUDE = ("*.com/fr*", "*/es/*")
EXCLUDE = ("ref=*",)

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_parquet_file(spark, f"{sf_dir}/documents.parquet")


def _volume(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("n_chars_sum"))


def _content(col: str) -> Column:
    """A number that follows from all values of a column in any order: sums of md5 beginnings."""
    start = F.substring(F.md5(F.coalesce(F.col(col), F.lit(""))), 1, 8)
    return F.sum(F.conv(start, 16, 10).cast("long")).alias("content")


def _longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


def _tasks(df: DataFrame, least: int) -> int:
    """At least so many, and one for each split of the input, so that a task does not grow with it."""
    return max(least, df.rdd.getNumPartitions())


def _in_ranges(documents: DataFrame, least: int) -> DataFrame:
    """Ranges of ids for as many tasks, each sorted; rows of one id stay in the order of the input.

    That order also cuts the ranges, so rows of one id, or of none, may be many tasks.
    """
    rows = documents.withColumn("_place", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(_tasks(documents, least), "doc_id", "_place")
    return ranged.sortWithinPartitions("doc_id", "_place").drop("_place")


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# Sources and sinks


def src_parquet_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of several files; those of a folder below it are not read."""
    path = scratch_path(spark, "folder")
    documents = _documents(spark, sf_dir)
    documents.repartition(_tasks(documents, 5)).write.parquet(path)
    documents.limit(3).write.parquet(f"{path}/below")
    return _volume(readers.read_parquet_dir(spark, path))


def src_parquet_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(_documents(spark, sf_dir))


def src_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("text").alias("problem"), F.col("source")))
    broken = F.substring(line, F.lit(1), F.length(line) - 1)
    lines = _documents(spark, sf_dir).select(
        F.when(F.col("doc_id") % 7 == 0, broken)
        .when(F.col("doc_id") % 11 == 0, "")
        .when(F.col("doc_id") % 13 == 0, F.to_json(F.array("doc_id")))
        .otherwise(line)
        .alias("value")
    )
    path = scratch_path(spark, "jsonl")
    lines.write.text(path)
    good, bad = readers.read_jsonl(spark, path)
    kept = good.agg(F.count("*").alias("n_rows"), _content("problem"))
    left = bad.agg(F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("content"))
    return kept.withColumn("kind", F.lit("good")).unionByName(left.withColumn("kind", F.lit("bad")))


def src_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dispatch")
    documents = _documents(spark, sf_dir)
    documents.write.parquet(f"{path}/parquet")
    documents.select(F.col("text").alias("problem")).write.json(f"{path}/lines")
    inputs = {
        "folder": f"{path}/parquet",
        "json lines": f"{path}/lines/*.json",
        "parquet file": f"{sf_dir}/documents.parquet",
    }
    counts = []
    for kind, target in inputs.items():
        rows = readers.read_corpus(spark, target)
        text = "problem" if kind == "json lines" else "text"
        found = rows.agg(F.count("*").alias("n_rows"), _content(text))
        counts.append(found.select(F.lit(kind).alias("kind"), "n_rows", "content"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def src_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "discover")
    _documents(spark, sf_dir).write.parquet(f"{path}/part/below")
    return _volume(readers.discover(spark, path))


def src_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits in one folder, of several files each."""
    path, parts = scratch_path(spark, "splits"), scratch_path(spark, "parts")
    split = F.when(F.col("doc_id") % 3 == 0, "validation").otherwise("train")
    rows = _documents(spark, sf_dir).withColumn("split", split)
    rows.repartition(_tasks(rows, 4)).write.partitionBy("split").parquet(parts)
    listed = paths.list_files(spark, parts, recursive=True)
    of_file = F.regexp_extract("path", "split=([a-z]+)/([^/]+)$", 1)
    name = F.concat(of_file, F.lit("-"), F.regexp_extract("path", "([^/]+)$", 1))
    named = listed.select(name.alias("source_file"), paths.plain_path(F.col("path")).alias("path"), "length")
    copies.copy_files(named, path)
    found = [
        _volume(readers.read_split(spark, path, one)).withColumn("split", F.lit(one))
        for one in ("train", "validation")
    ]
    return found[0].unionByName(found[1])


def src_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(readers.read_glob(spark, f"{sf_dir}/doc*.parquet"))


def path_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return paths.select_paths(pages, "url", INCLUDE, EXCLUDE).select("page_id", "url")


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    entries = F.sort_array(F.collect_list(F.struct(F.col("url").alias("rfilename"))))
    block = F.floor(F.col("page_id") / 20).alias("block")  # twenty files a manifest
    manifests = pages.groupBy(block).agg(F.to_json(F.struct(entries.alias("siblings"))).alias("manifest"))
    return paths.manifest_files(manifests).select("block", "dir", "name")


def write_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "filtered")
    sink.write_filtered(curate.curate(reasoning(spark, sf_dir)), path, gather=True)
    written = spark.read.parquet(path)
    return written.groupBy("source_file").agg(
        F.count("*").alias("n_rows"), _content("generated_solution")
    )


def _per_file(df: DataFrame) -> DataFrame:
    return df.groupBy("source_file").agg(F.count("*").alias("n_rows"))


def sample_files_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_file(files.sample_files(reasoning(spark, sf_dir), count=3, seed=SEED))


def sample_files_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_file(files.sample_files(reasoning(spark, sf_dir), ratio=0.1, seed=SEED))


def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_offsets(reasoning(spark, sf_dir))


def file_offsets_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.file_offsets(reasoning(spark, sf_dir), seed=SEED)


def row_at_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rank_rows(reasoning(spark, sf_dir)).select("example_id", "global_idx")


def global_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents.parquet` may be a file or a folder of files, numbered by name; its name is given."""
    rows = readers.read_parquet_dir(spark, f"{sf_dir}/documents.parquet", "*")
    rows = readers.with_source_file(rows, sf_dir)
    table = F.regexp_replace("source_file", r"^documents\.parquet/.*$", "documents.parquet")
    return files.with_global_index(rows).select("doc_id", table.alias("source_file"), "global_idx")


def rows_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 0, 7, 500 and the last one of a folder of several files."""
    path = scratch_path(spark, "numbered")
    documents = _documents(spark, sf_dir)
    _in_ranges(documents, 4).write.parquet(path)
    last = documents.count() - 1
    found = files.rows_at(spark, path, [i for i in (0, 7, 500, last) if i <= last])
    return found.select("global_idx", "doc_id")


def row_group_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th row and the last one, out of files with many row groups; whole texts."""
    path = scratch_path(spark, "grouped")
    documents = _documents(spark, sf_dir)
    _in_ranges(documents, 3).write.option("parquet.block.size", 1 << 20).parquet(path)
    last = documents.count() - 1
    wanted = sorted({*range(0, last + 1, 50), last} - {-1})
    found = footers.lookup(spark, path, wanted, readers.schema_of_file(spark))
    return found.select("global_idx", "doc_id", F.md5("text").alias("text_md5"))


def sample_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three whole sources, copied byte for byte, and what the copies hold; a large one is several files."""
    path = scratch_path(spark, "by-source")
    rows = reasoning(spark, sf_dir).hint("rebalance", "source_file")  # a large source is several tasks
    rows.write.partitionBy("source_file").parquet(path)
    listed = paths.list_files(spark, path, recursive=True)
    file = paths.plain_path(F.col("path"))
    below = paths.relative_path(file, path)
    listed = listed.select(file.alias("path"), "length", below.alias("name"))
    folder = F.regexp_extract("name", "^source_file=([^/]+)/", 1)
    chosen = files.sample_files(listed.withColumn("source_file", folder), count=3, seed=SEED)
    target = scratch_path(spark, "copies")
    copies.copy_files(chosen.select(F.col("name").alias("source_file"), "path", "length"), target)
    return spark.read.parquet(target).groupBy("source_file").agg(
        F.count("*").alias("n_rows"), _content("generated_solution")
    )


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.profile(reasoning(spark, sf_dir), required=REQUIRED)


# Curation


def filter_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.drop_no_answer(reasoning(spark, sf_dir)).select("example_id")


def lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoning(spark, sf_dir).select(
        "example_id", T.to_number("pass_rate_72b_tir").alias("pass_rate")
    )


def filter_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = curate.filter_pass_rate(reasoning(spark, sf_dir), 0.8)
    return kept.select("example_id", T.to_number("pass_rate_72b_tir").alias("pass_rate"))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reasoning(spark, sf_dir, spread_rows=True).select(
        "example_id", curate.combined_length(curate.CurateConfig()).alias("n_tokens")
    )


def filter_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.filter_length(reasoning(spark, sf_dir), 2048).select("example_id")


def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.funnel(reasoning(spark, sf_dir, spread_rows=True))


def curate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.curate(reasoning(spark, sf_dir))


def curate_mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a pass rate, without a problem, and with numbers for pass rates, in one folder."""
    path = scratch_path(spark, "mixed")
    rows = reasoning(spark, sf_dir).drop("source_file").withColumn("k", F.col("example_id") % 4)
    kinds = {
        "whole": rows,
        "unrated": rows.drop("pass_rate_72b_tir"),
        "unasked": rows.drop("problem"),
        "numbers": rows.withColumn("pass_rate_72b_tir", T.to_number("pass_rate_72b_tir")),
    }
    for k, (kind, some) in enumerate(kinds.items()):
        some.filter(F.col("k") == k).drop("k").write.parquet(f"{path}/{kind}")
    kept = curate.curate(curate.read_files(spark, path))
    kind = F.substring_index("source_file", "/", 1).alias("kind")
    texts = [F.md5(c).alias(f"{c}_md5") for c in ("problem", "generated_solution")]
    return kept.select("example_id", kind, *texts)


# Examples


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.build_examples(reasoning(spark, sf_dir, spread_rows=True), CFG)


def _examples_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read the examples several times."""
    return write_once(_examples(spark, sf_dir).select("example_id", *examples.EXAMPLE_COLUMNS), "examples")


def render_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = examples.render_prompt(reasoning(spark, sf_dir), SYSTEM_PROMPT)
    return rendered.select("example_id", "prompt", "full_text")


def boxed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.with_boxed_answer(reasoning(spark, sf_dir), "generated_solution")
    return _longs(rows.select("example_id", "has_box", "answer", "c0", "c1"), "c0", "c1")


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reasoning(spark, sf_dir, spread_rows=True)
    rendered = examples.render_prompt(rows, SYSTEM_PROMPT)
    return _longs(spans.token_spans(rendered, "full_text"), "i", "s", "e")


def _piece_tokenizer():
    """The library's tokenizer with the token rule of this corpus and no vocabulary."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({"?": 0}, unk_token="?"))
    blank = pre_tokenizers.Split(Regex(f"[{T.WHITESPACE}]+"), "removed")
    token = pre_tokenizers.Split(Regex(r"</?think>|</?answer>|[\p{L}\p{N}]+|."), "isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([blank, token])
    return made


def batch_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a batch tokenizer, with the text that each one covers."""
    rows = reasoning(spark, sf_dir, spread_rows=True)
    rendered = examples.render_prompt(rows, SYSTEM_PROMPT).select("example_id", "full_text")
    found = spans.token_spans(rendered, "full_text", tokenizer=BatchTokenizer(_piece_tokenizer))
    return _longs(found.select("example_id", "i", "s", "e"), "i", "s", "e")


def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = examples.pad_truncate(F.col("tokens"), CFG.max_length, examples.PAD)
    rows = _examples(spark, sf_dir).select("example_id", padded.alias("t"))
    return rows.select(
        "example_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("text")
    )


def target_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select(
        "example_id", F.col("target_start").cast("long").alias("start")
    )


def _mask(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _longs(examples.mask_rows(_examples(spark, sf_dir), name), "i")

    return query


def think_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _examples(spark, sf_dir).select(
        "example_id",
        F.col("think_open").cast("long").alias("open_i"),
        F.col("think_close").cast("long").alias("close_i"),
        "think_status",
    )


def build_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_tok", "n_tgt", "n_think", "n_ans")
    return _longs(_examples(spark, sf_dir).select("example_id", *counts, "status"), *counts)


def example_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples.example_report(_examples(spark, sf_dir))


def shifted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _examples(spark, sf_dir).select(
        "example_id", examples.shifted(F.col("tokens")).alias("t")
    )
    return rows.select(
        "example_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("text")
    )


def build_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return vocab.build_vocab(vocab.block_tokens(blocks)).select("token", "id")


def _blocks(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> DataFrame:
    return vocab.token_blocks(_examples(spark, sf_dir), carry=carry)


def encode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    words = vocab.build_vocab(vocab.block_tokens(blocks))
    ids = vocab.encode_blocks(blocks, words)
    return _longs(ids.select("example_id", F.posexplode("token_ids").alias("i", "id")), "i")


def _set(mask: Column, outside) -> Column:
    return F.size(F.array_remove(mask, outside)).cast("long")


def example_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the fixed-length arrays in their order, and how many entries each mask sets."""
    blocks = _blocks(spark, sf_dir, examples.POSITION_COLUMNS)
    words = vocab.build_vocab(vocab.block_tokens(blocks))
    encoded = vocab.encode_blocks(blocks, words)
    arrays = examples.example_arrays(encoded, CFG, "token_ids")

    def digest(name: str) -> Column:
        return F.md5(F.array_join(F.col(name).cast("array<string>"), " ")).alias(f"{name}_md5")

    return arrays.select(
        "example_id",
        F.size("input_ids").cast("long").alias("n"),
        *map(digest, ("input_ids", "loss_mask", "think_mask", "answer_mask")),
        _set(F.col("attention_mask"), 0).alias("n_tok"),
        _set(F.col("loss_mask"), 0).alias("n_tgt"),
        _set(F.col("think_mask"), False).alias("n_think"),
        _set(F.col("answer_mask"), False).alias("n_ans"),
    )


def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


# Order, shards, batches


def shuffle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffle_files(reasoning(spark, sf_dir), SEED)


def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffle_rows(reasoning(spark, sf_dir).select("example_id"), SEED)


def assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.assign_shards(reasoning(spark, sf_dir).select("example_id"), 4, SEED)


def assign_shards_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = reasoning(spark, sf_dir).select("example_id")
    return batching.assign_shards(keys, 7, SEED, epoch=1, pad=True)


def assign_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = batching.assign_shards(reasoning(spark, sf_dir).select("example_id"), 2, SEED)
    return batching.assign_batches(shards, 4).drop("slot")


def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys alone are put in order and batched; then the usable examples find their batch."""
    keys = reasoning(spark, sf_dir).select("example_id")
    batches = batching.assign_batches(batching.assign_shards(keys, 2, SEED), 4)
    rows = _examples(spark, sf_dir).select("example_id", *examples.EXAMPLE_COLUMNS)
    usable = rows.filter(F.col("status") == "ok")
    made = batching.collate(usable.join(batches, "example_id"), CFG)

    def digest(name: str) -> Column:
        """All entries of a batch's arrays in their order: a swapped row or entry changes it."""
        rows = F.transform(name, lambda row: F.array_join(row.cast("array<string>"), " "))
        return F.md5(F.array_join(rows, chr(10))).alias(f"{name}_md5")

    return made.select(
        "shard", "batch_id", "n_kept", *map(digest, ("input_ids", "loss_mask", "answer_mask"))
    )


# Scores


def token_ce_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return _rounded(rows.select("vec_id", token_ce("embedding", "label").alias("ce")), "ce")


def token_ce_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same losses from chunks of 24 logits of each position."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    starts = F.explode(F.sequence(F.lit(0), F.size("embedding") - 1, F.lit(24))).alias("first_id")
    cut = rows.select("vec_id", "label", "embedding", starts)
    chunks = cut.withColumn("logits", F.slice("embedding", F.col("first_id") + 1, 24))
    return _rounded(logits.chunked_ce(chunks.drop("embedding"), "vec_id"), "ce")


def score_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Usable examples, and a loss for each of their predicted tokens.

    The loss stands in for a model's: minus the log of the token's share of
    those tokens.
    """
    return score_input_of(_examples_once(spark, sf_dir))


def score_input_of(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    usable = made.filter(F.col("status") == "ok").withColumn(
        "batch_id", F.col("example_id") % N_BATCHES
    )
    tokens = vocab.token_rows(usable).filter(F.col("i") >= 1)
    counts = write_once(tokens.groupBy("token").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 1
    losses = counts.select("token", "n", (-F.log(F.col("n") / total)).alias("loss"))
    rows = vocab.join_counts(tokens, losses, total)
    return usable, rows.select("example_id", "i", "loss")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, losses = score_input(spark, sf_dir)
    return scores.score_tokens(usable, losses, ("batch_id",))


def base_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.base_loss(_scored(spark, sf_dir), "batch_id"), "base")


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.efficiency(_scored(spark, sf_dir)), "score")


def efficiency_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.efficiency_batch(_scored(spark, sf_dir), "batch_id"), "eff")


def _usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = _examples(spark, sf_dir).filter(F.col("status") == "ok")
    return usable.withColumn("batch_id", F.col("example_id") % N_BATCHES)


def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.repetition(_usable(spark, sf_dir)), "score")


def repetition_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scores.repetition_batch(_usable(spark, sf_dir), "batch_id"), "rep")


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable, losses = score_input(spark, sf_dir)
    result = scores.combined(usable, losses, "batch_id")
    return _rounded(result, "base", "eff", "rep", "total")


def batch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of the batches that shards of the shuffled corpus are cut into."""
    usable, losses = score_input(spark, sf_dir)
    keys = reasoning(spark, sf_dir).select("example_id")
    batches = batching.assign_batches(batching.assign_shards(keys, 2, SEED), 4).drop("slot")
    batched = usable.drop("batch_id").join(batches, "example_id")
    result = scores.combined(batched, losses, ("shard", "batch_id"))
    return _rounded(result, "base", "eff", "rep", "total")


QUERIES: dict[str, Query] = {
    "src_parquet_dir": src_parquet_dir,
    "src_parquet_file": src_parquet_file,
    "src_jsonl": src_jsonl,
    "src_dispatch": src_dispatch,
    "src_discover": src_discover,
    "src_split": src_split,
    "src_glob": src_glob,
    "path_select": path_select,
    "manifest_files": manifest_files,
    "write_filtered": write_filtered,
    "sample_files_count": sample_files_count,
    "sample_files_ratio": sample_files_ratio,
    "file_offsets": file_offsets,
    "file_offsets_shuffled": file_offsets_shuffled,
    "row_at_index": row_at_index,
    "global_index": global_index,
    "rows_at": rows_at,
    "row_group_lookup": row_group_lookup,
    "sample_copies": sample_copies,
    "profile": profile,
    "filter_answer": filter_answer,
    "lenient_cast": lenient_cast,
    "filter_pass_rate": filter_pass_rate,
    "token_count": token_count,
    "filter_length": filter_length,
    "filter_funnel": filter_funnel,
    "curate": curate_all,
    "curate_mixed_files": curate_mixed_files,
    "render_prompt": render_prompt,
    "boxed_answer": boxed_answer,
    "token_spans": token_spans,
    "batch_spans": batch_spans,
    "pad_truncate": pad_truncate,
    "target_start": target_start,
    "loss_mask": _mask("loss_mask"),
    "think_mask": _mask("think_mask"),
    "answer_mask": _mask("answer_mask"),
    "think_integrity": think_integrity,
    "examples": build_examples,
    "example_report": example_report,
    "example_arrays": example_arrays,
    "shifted_labels": shifted_labels,
    "vocab": build_vocab,
    "encode_ids": encode_ids,
    "render_chat": render_chat,
    "shuffle_files": shuffle_files,
    "shuffle_rows": shuffle_rows,
    "assign_shards": assign_shards,
    "assign_shards_padded": assign_shards_padded,
    "assign_batches": assign_batches,
    "collate": collate,
    "token_ce": token_ce_query,
    "token_ce_chunked": token_ce_chunked,
    "base_loss": base_loss,
    "efficiency": efficiency,
    "efficiency_batch": efficiency_batch,
    "repetition": repetition,
    "repetition_batch": repetition_batch,
    "combined": combined,
    "batch_scores": batch_scores,
}

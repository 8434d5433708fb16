"""Jobs: `python -m reasonloom curate|report|sample|copy|examples|batches|scores ...`, or spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from reasonloom.operators.batching import assign_batches, assign_shards, collate
from reasonloom.operators.curate import CurateConfig, curate_files, funnel, read_files
from reasonloom.operators.examples import (
    DEFAULT_SYSTEM_PROMPT,
    EXAMPLE_COLUMNS,
    POSITION_COLUMNS,
    ExampleConfig,
    build_examples,
)
from reasonloom.operators.file_runs import curate_each
from reasonloom.operators.rank_files import write_ranks
from reasonloom.operators.scores import combined, loss_gaps
from reasonloom.operators.vocab import build_vocab, encode_examples, token_rows
from reasonloom.session import remove_scratch
from reasonloom.sources.copies import sample_copies
from reasonloom.sources.files import sample_files
from reasonloom.sources.paths import list_source_files
from reasonloom.sources.readers import (
    ABSENT,
    CORPUS_COLUMNS,
    only_below,
    read_corpus,
    read_differing,
    skipped_files,
)
from reasonloom.sources.sink import write_filtered

KEEP_GOING = "file by file with a log: failing files stop no others, a further run goes on"
SKIP = "leave out unreadable and damaged files, and name them"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="reasonloom")
    jobs = parser.add_subparsers(dest="job", required=True)

    for name, text in (("curate", "filter a corpus"), ("report", "rows left after each step")):
        job = jobs.add_parser(name, help=text)
        job.add_argument("source_dir")
        job.add_argument("target_dir")
        job.add_argument("--max_len", type=int, default=2048)
        job.add_argument("--pass_rate", type=float, default=0.8)
        job.add_argument("--skip_corrupt", action="store_true", help=SKIP)
        if name == "curate":
            job.add_argument("--keep_going", action="store_true", help=KEEP_GOING)

    # The names and defaults of these options.
    for name, text in (
        ("sample", "take the rows of whole files at random"),
        ("copy", "copy whole files at random, byte for byte"),
    ):
        job = jobs.add_parser(name, help=text)
        job.add_argument("--source_dir", required=True)
        job.add_argument("--target_dir", required=True)
        job.add_argument("--sample_ratio", type=float)
        job.add_argument("--sample_count", type=int)
        job.add_argument("--seed", type=int, default=42)
        if name == "sample":
            job.add_argument("--skip_corrupt", action="store_true", help=SKIP)
        else:
            job.add_argument("--skip_failing", action="store_true", help="go on after failing files")

    job = jobs.add_parser("examples", help="build training examples with a status per row")
    job.add_argument("source")
    job.add_argument("target_dir")
    job.add_argument("--max_length", type=int, default=1024)
    job.add_argument("--system_prompt", default=DEFAULT_SYSTEM_PROMPT, help="empty for none")

    job = jobs.add_parser("batches", help="examples, vocabulary and collated batches of a folder")
    job.add_argument("source_dir")
    job.add_argument("target_dir")
    job.add_argument("--max_length", type=int, default=1024)
    job.add_argument("--system_prompt", default=DEFAULT_SYSTEM_PROMPT, help="empty for none")
    job.add_argument("--shards", type=int, default=1)
    job.add_argument("--batch_size", type=int, default=2)
    job.add_argument("--seed", type=int, default=42)
    job.add_argument("--epoch", type=int, default=0)

    job = jobs.add_parser("scores", help="scores of the batches from token losses")
    job.add_argument("batches_dir", help="what `batches` wrote")
    job.add_argument("losses", help="Parquet: example_id, i, loss")
    job.add_argument("target_dir")
    return parser


def _say_skipped(spark: SparkSession, root: str) -> None:
    """Name the files that a skipping job left out, with the rows they promise."""
    left_out = skipped_files(spark, root, recursive=only_below(spark, root))
    for row in left_out.toLocalIterator():
        print(f"skipped {row['path']}: {row['rows_read']} of {row['rows_promised']} rows readable")


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"reasonloom-{args.job}").getOrCreate()
    try:
        _run(spark, args)
    finally:
        remove_scratch(spark)


def _write_batches(spark: SparkSession, args: argparse.Namespace) -> None:
    """`examples` with their batch, `vocab` and `batches` of token ids, below the target folder.

    A row's key is its file and its number in it. Files may differ in columns and types. The
    batches are in the order in which each shard takes them, with an index of the files.
    """
    cfg = ExampleConfig(args.max_length, args.system_prompt)
    rows = read_differing(spark, args.source_dir, row_numbers=True)
    absent = [c for c in CORPUS_COLUMNS if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in absent})
    key = F.concat_ws("#", "source_file", F.col("row_in_file").cast("string"))
    rows = rows.withColumn("example_id", key)
    shards = assign_shards(rows.select("example_id"), args.shards, args.seed, args.epoch)
    made = build_examples(rows, cfg).select("example_id", *EXAMPLE_COLUMNS)
    placed = made.filter("status = 'ok'").join(assign_batches(shards, args.batch_size), "example_id")
    placed.write.mode("overwrite").parquet(f"{args.target_dir}/examples")
    usable = spark.read.parquet(f"{args.target_dir}/examples")
    build_vocab(token_rows(usable)).write.mode("overwrite").parquet(f"{args.target_dir}/vocab")
    words = spark.read.parquet(f"{args.target_dir}/vocab")
    carry = (*POSITION_COLUMNS, "shard", "batch_id", "slot", "status")
    encoded = encode_examples(usable, words, carry=carry)
    write_ranks(collate(encoded, cfg, "token_ids"), f"{args.target_dir}/batches")


def _write_scores(spark: SparkSession, args: argparse.Namespace) -> None:
    usable = spark.read.parquet(f"{args.batches_dir}/examples")
    losses = spark.read.parquet(args.losses)
    gaps = loss_gaps(usable, losses).count()
    if gaps:
        print(f"{gaps} examples have missing, repeated or null losses")
    found = combined(usable, losses, ("shard", "batch_id"))
    found.write.mode("overwrite").parquet(args.target_dir)


def _ratio(args: argparse.Namespace) -> float | None:
    """The share of files to take; a tenth if neither a share nor a number is given."""
    neither = args.sample_ratio is None and args.sample_count is None
    return 0.1 if neither else args.sample_ratio


def _run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "curate":
        cfg = CurateConfig(args.max_len, args.pass_rate)
        if args.keep_going:
            log = curate_each(spark, args.source_dir, args.target_dir, cfg)
            for row in log.filter("status = 'failed'").toLocalIterator():
                print(f"failed {row['source_file']}: {row['error']}")
        else:
            curate_files(spark, args.source_dir, args.target_dir, cfg, args.skip_corrupt)
    elif args.job == "report":
        cfg = CurateConfig(args.max_len, args.pass_rate)
        rows = funnel(read_files(spark, args.source_dir, args.skip_corrupt), cfg)
        rows.write.mode("overwrite").parquet(args.target_dir)
    elif args.job == "copy":
        how = {"count": args.sample_count, "seed": args.seed, "skip_failing": args.skip_failing}
        manifest = sample_copies(spark, args.source_dir, args.target_dir, _ratio(args), **how)
        for row in manifest.filter("error IS NOT NULL").toLocalIterator():
            print(f"not copied {row['path']}: {row['error']}")
    elif args.job == "sample":
        ratio = _ratio(args)
        rows = read_differing(spark, args.source_dir, skip_corrupt=args.skip_corrupt).drop(ABSENT)
        listing = list_source_files(spark, args.source_dir)
        chosen = sample_files(rows, ratio, args.sample_count, args.seed, listing=listing)
        write_filtered(chosen, args.target_dir)
    elif args.job == "batches":
        _write_batches(spark, args)
    elif args.job == "scores":
        _write_scores(spark, args)
    else:
        cfg = ExampleConfig(args.max_length, args.system_prompt)
        rows = build_examples(read_corpus(spark, args.source), cfg)
        rows.write.mode("overwrite").parquet(args.target_dir)
    if getattr(args, "skip_corrupt", False):
        _say_skipped(spark, args.source_dir)


if __name__ == "__main__":
    main()

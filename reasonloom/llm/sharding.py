"""Documents dealt to shards of nearly equal bytes, in ranges of a key.

The key of a row is the hash of its text, then a hash of its other values: copies stand together.

1. The keys and sizes of all rows are written once, without texts. Keys are sampled by weight: a
   row is drawn once for every so many bytes, so a sample stands for equal bytes.
2. Quantiles of the sample are the splitters of ranges. They never part copies of one text, unless
   these are heavy. A range that turns out larger than twice its due is sampled again, alone, and
   subdivided, as long as it holds more than one key.
3. A group of copies is heavy if it has more than `heavy` of a shard's bytes: fewer than
   shards / heavy groups are, and their sizes are counted exactly. Those that fit go to one shard
   each, the largest first, to the emptiest shard; the others are subdivided like any range.
4. All other rows stand in a line by key, and the line is cut where the shards are full. The seven
   ranges that hold a cut of eight shards are added up row by row, so that the cut falls between
   the right two texts. So a shard is off by half a light group or row at either end.
5. With the cuts as further splitters a range belongs to one shard. Its rows are counted, and so
   the first slot of each range is known before a text moves. Texts are shuffled once, by range:
   a partition holds neighbouring ranges of about equal bytes, and numbers the rows of each.

Copies stay together but for heavy groups that fit nowhere and for groups that a cut meets in
several rows of a subdivided range. The driver holds samples (at most `max_ranges` times
`samples`) and a few numbers for each range, never rows.

Defined results: a null text has no bytes; every row has one byte more than its text, so that
empty texts count; null ids are kept; rows equal in all columns have one key and stand
together; ties of text hashes are ordered by the other values; an empty table gives no row; a
very long text is one row, and a shard is off by its size at most. Columns of the result that the
table has already are replaced. The table is read several times and must not change meanwhile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonloom.llm.columns import fresh
from reasonloom.session import write_once

KEY = np.dtype([("h", np.int64), ("t", np.int64)])
LEAST = np.iinfo(np.int64).min
HASHABLE = ("bigint", "int", "smallint", "tinyint", "string", "double", "float", "boolean", "date")


@dataclass(frozen=True)
class ShardConfig:
    n_shards: int = 8
    ranges_per_shard: int = 64
    range_bytes: int = 1 << 30  # more ranges rather than larger ones, up to max_ranges
    max_ranges: int = 1 << 17
    samples: int = 16  # for every range
    heavy: float = 0.01
    rounds: int = 8  # of subdividing

    def __post_init__(self):
        if self.n_shards < 1 or not 0 < self.heavy <= 1:
            raise ValueError("at least one shard, and a share of it for heavy groups")


def size_of() -> Column:
    """The bytes of a row's text and one more."""
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 1


def _with_key(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The table with its key columns, and their names."""
    h, t = fresh(docs, "h"), fresh(docs, "t")
    others = sorted(c for c, kind in docs.dtypes if kind in HASHABLE and c.lower() != "text")
    keyed = docs.withColumns(
        {
            h: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
            t: F.xxhash64(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0).cast("long"),
        }
    )
    return keyed, h, t


def _records(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    made = np.zeros(len(h), KEY)
    made["h"], made["t"] = h, t
    return made


def find_range(splitters: np.ndarray, h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each key the number of splitters that are not above it."""
    left = np.searchsorted(splitters["h"], h, side="left")
    right = np.searchsorted(splitters["h"], h, side="right")
    found = right.copy()
    several = np.flatnonzero(left < right)  # splitters within one text
    for k in np.unique(h[several]):
        some = several[h[several] == k]
        first, end = left[some[0]], right[some[0]]
        found[some] = first + np.searchsorted(splitters["t"][first:end], t[some], side="right")
    return found


def _range_column(splitters: np.ndarray, h: str, t: str) -> Column:
    h_of, t_of = splitters["h"].copy(), splitters["t"].copy()

    @F.pandas_udf("int")
    def number(h: pd.Series, t: pd.Series) -> pd.Series:
        found = find_range(_records(h_of, t_of), h.to_numpy(), t.to_numpy())
        return pd.Series(found.astype(np.int32))

    return number(h, t)


def _drawn(keys: DataFrame, per_sample: float) -> pd.DataFrame:
    """Keys drawn by weight, with the number of draws of each: about one for `per_sample` bytes."""
    # 53 bits of the hash as a fraction: rows of any smallness are drawn at their rate
    chance = F.shiftrightunsigned(F.xxhash64("t", "h", F.lit(17)), 11).cast("double") / float(1 << 53)
    draws = F.floor(F.col("size") / F.lit(float(per_sample)) + chance)
    table = keys.select("h", "t", draws.alias("draws")).filter("draws > 0").toArrow()
    return table.to_pandas().sort_values(["h", "t"], ignore_index=True)


def _quantiles(drawn: pd.DataFrame, each: float) -> np.ndarray:
    """The keys after every `each` draws."""
    ends = drawn["draws"].cumsum().to_numpy()
    if not len(ends):
        return np.zeros(0, KEY)
    wanted = np.arange(1, int(ends[-1] / each) + 1) * each
    at = np.minimum(np.searchsorted(ends, wanted, side="left") + 1, len(ends) - 1)
    return _records(drawn["h"].to_numpy()[at], drawn["t"].to_numpy()[at])


def _whole_groups(splitters: np.ndarray, heavy: set[int]) -> np.ndarray:
    """Splitters before whole groups of copies; heavy groups get ranges of their own."""
    light = ~np.isin(splitters["h"], list(heavy))
    splitters = splitters.copy()
    splitters["t"][light] = LEAST
    own = sorted(heavy | {h + 1 for h in heavy if h < np.iinfo(np.int64).max})
    edges = _records(np.array(own, np.int64), np.full(len(own), LEAST))
    return np.unique(np.concatenate([splitters, edges]))


def _totals(keys: DataFrame, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and rows of each range, and whether it holds more than one key."""
    ranged = keys.withColumn("range", _range_column(splitters, "h", "t"))
    key = F.struct("h", "t")
    table = (
        ranged.groupBy("range")
        .agg(F.sum("size").alias("size"), F.count("*").alias("n"), (F.min(key) != F.max(key)).alias("many"))
        .toArrow()
    )
    out = [np.zeros(len(splitters) + 1, kind) for kind in (np.int64, np.int64, bool)]
    for values, name in zip(out, ("size", "n", "many"), strict=True):
        values[table["range"].to_numpy()] = table[name].to_numpy()
    return out[0], out[1], out[2]


def _heavy_groups(keys: DataFrame, drawn: pd.DataFrame, least: float, share: float) -> dict[int, int]:
    """Exact sizes of the groups of copies of at least `least` bytes, the sample's candidates."""
    draws = drawn.groupby("h")["draws"].sum()
    likely = draws[draws >= 0.4 * share].index.to_list()
    if not likely:
        return {}
    counted = keys.filter(F.col("h").isin(likely)).groupBy("h").agg(F.sum("size").alias("size"))
    return {r["h"]: r["size"] for r in counted.filter(F.col("size") >= least).collect()}


def _fitted(heavy: dict[int, int], n_shards: int, capacity: float) -> tuple[dict[int, int], list]:
    """Heavy groups that fit into one shard, with it, and the bytes that each shard so has."""
    filled = [0] * n_shards
    placed: dict[int, int] = {}
    for h, size in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        shard = filled.index(min(filled))
        if filled[shard] + size <= capacity:
            filled[shard] += size
            placed[h] = shard
    return placed, filled


def _cuts(keys: DataFrame, splitters: np.ndarray, cuts: list, line: np.ndarray, heavy: list) -> np.ndarray:
    """The key at which each cut falls; `line` is the place where each range begins, or -1."""
    on_line = np.flatnonzero(line >= 0)
    at = on_line[np.searchsorted(line[on_line], cuts, side="right") - 1]
    wanted = sorted(set(at.tolist()))
    starts = F.create_map(*(F.lit(int(x)) for r in wanted for x in (r, line[r])))
    rows = keys.withColumn("range", _range_column(splitters, "h", "t"))
    rows = rows.filter(F.col("range").isin(wanted)).withColumn("heavy", F.col("h").isin(heavy))
    before = Window.partitionBy("range").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("range", "h")
    placed = rows.withColumn("begin", starts[F.col("range")] + F.coalesce(F.sum("size").over(before), F.lit(0)))
    middle = F.when(F.col("heavy"), F.col("begin") + F.col("size") / 2).otherwise(
        F.min("begin").over(group) + F.sum("size").over(group) / 2
    )
    key = F.struct("h", F.when(F.col("heavy"), F.col("t")).otherwise(F.lit(LEAST)).alias("t"))
    placed = placed.select("range", middle.alias("middle"), key.alias("key"))
    firsts = [
        F.min(F.when((F.col("range") == int(r)) & (F.col("middle") >= float(c)), F.col("key")))
        for r, c in zip(at, cuts, strict=True)
    ]
    found = placed.agg(*(f.alias(f"cut{i}") for i, f in enumerate(firsts))).first()
    out = []
    for r, key_of in zip(at, found, strict=True):
        if key_of is not None:
            out.append((key_of["h"], key_of["t"]))
        else:  # the whole range lies before the cut
            out.append(tuple(splitters[r].tolist()) if r < len(splitters) else None)
    end = (np.iinfo(np.int64).max, np.iinfo(np.int64).max)
    return np.array([end if x is None else x for x in out], KEY)


@dataclass(frozen=True)
class Layout:
    """Where each range goes. Arrays by range: shard, first slot, and bytes."""

    splitters: np.ndarray
    shard: np.ndarray
    first_slot: np.ndarray
    size: np.ndarray
    rounds: int


def plan(docs: DataFrame, cfg: ShardConfig | None = None) -> Layout:
    """Sample, split, subdivide and cut; reads the table's keys and sizes alone."""
    cfg = cfg or ShardConfig()
    keyed, h, t = _with_key(docs.drop("shard", "slot"))
    keys = write_once(
        keyed.select(F.col(h).alias("h"), F.col(t).alias("t"), size_of().alias("size")), "keys"
    )
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        empty = np.zeros(1, np.int64)
        return Layout(np.zeros(0, KEY), empty, empty, empty, 0)
    n_ranges = max(cfg.ranges_per_shard * cfg.n_shards, math.ceil(total / cfg.range_bytes))
    n_ranges = min(n_ranges, max(cfg.max_ranges, cfg.n_shards))
    due = total / n_ranges
    drawn = _drawn(keys, due / cfg.samples)
    capacity = total / cfg.n_shards
    share = cfg.heavy * n_ranges * cfg.samples / cfg.n_shards
    heavy = _heavy_groups(keys, drawn, cfg.heavy * capacity, share)
    splitters = _whole_groups(_quantiles(drawn, cfg.samples), set(heavy))
    rounds = 0
    for rounds in range(cfg.rounds + 1):
        size, _, many = _totals(keys, splitters)
        over = np.flatnonzero((size > 2 * due) & many)
        if not len(over) or rounds == cfg.rounds:
            break
        inside = F.col("range").isin(over.tolist())
        again = keys.withColumn("range", _range_column(splitters, "h", "t")).filter(inside)
        # each range over its due is sampled so that its parts have enough draws
        more = _quantiles(_drawn(again, due / (4 * cfg.samples)), 2 * cfg.samples)
        refined = _whole_groups(np.concatenate([splitters, more]), set(heavy))
        if len(refined) == len(splitters):  # nothing but single groups is left
            break
        splitters = refined

    placed, filled = _fitted(heavy, cfg.n_shards, capacity)
    fixed = _fixed_shards(splitters, placed)
    line = np.where(fixed < 0, np.cumsum(np.where(fixed < 0, size, 0)) - size, -1)
    cuts = np.cumsum([capacity - f for f in filled])[:-1].tolist()
    if cuts and (fixed < 0).any():
        bounds = _cuts(keys, splitters, cuts, line, sorted(heavy))
        splitters = np.unique(np.concatenate([splitters, bounds]))
    else:
        bounds = np.zeros(0, KEY)
    size, n, _ = _totals(keys, splitters)
    firsts = np.concatenate([np.array([(LEAST, LEAST)], KEY), splitters])
    shard = np.searchsorted(np.sort(bounds), firsts, side="right")
    fixed = _fixed_shards(splitters, placed)
    shard = np.where(fixed < 0, shard, fixed)
    first_slot = np.zeros(len(n), np.int64)
    for s in range(cfg.n_shards):
        mine = shard == s
        first_slot[mine] = np.cumsum(n[mine]) - n[mine]
    return Layout(splitters, shard, first_slot, size, rounds)


def _fixed_shards(splitters: np.ndarray, placed: dict[int, int]) -> np.ndarray:
    """The shard of each range that lies in a placed group, -1 for the others."""
    firsts = np.concatenate([[LEAST], splitters["h"]])
    fixed = np.array([placed.get(h, -1) for h in firsts.tolist()])
    fixed[0] = -1 if not len(splitters) or splitters["h"][0] != LEAST else fixed[0]
    return fixed


def shard(docs: DataFrame, cfg: ShardConfig | None = None, layout: Layout | None = None) -> DataFrame:
    """The table with `shard` and `slot` (from 0 in each shard), range-partitioned by shard."""
    layout = layout or plan(docs, cfg)
    docs = docs.drop("shard", "slot")
    keyed, h, t = _with_key(docs)
    spark = docs.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = np.cumsum(layout.size)
    part_of = ((ends - layout.size / 2) * n_parts / max(1, ends[-1])).astype(np.int64)
    h_of, t_of = layout.splitters["h"].copy(), layout.splitters["t"].copy()
    place = {"range": np.arange(len(part_of)), "shard": layout.shard}
    place |= {"first": layout.first_slot, "part": part_of}

    @F.pandas_udf("range int, shard int, first long, part int")
    def look_up(h: pd.Series, t: pd.Series) -> pd.DataFrame:
        found = find_range(_records(h_of, t_of), h.to_numpy(), t.to_numpy())
        return pd.DataFrame({name: values[found] for name, values in place.items()})

    at = fresh(keyed, "at")
    ranged = keyed.withColumn(at, look_up(h, t)).select("*", F.col(f"{at}.part").alias(f"{at}part"))
    dealt = ranged.repartition(n_parts, f"{at}part")
    # the shuffle by part serves the window too: a range lies in one part
    rows = Window.partitionBy(f"{at}part", f"{at}.range").orderBy(h, t)
    slot = F.col(f"{at}.first") + F.row_number().over(rows) - 1
    return dealt.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col(f"{at}.shard").alias("shard"),
        slot.cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, cfg: ShardConfig | None = None) -> None:
    """One folder `shard=<n>` of Parquet files for each shard, rows in slot order inside a file."""
    sharded = shard(docs, cfg)
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


def digest(sharded: DataFrame) -> DataFrame:
    """Of each sharded document its size, the checksum of its text and its place."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return sharded.select(
        "doc_id",
        size_of().alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )

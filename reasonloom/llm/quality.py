"""Quality rules as a short-circuit cascade of native expressions.

Every rule is a condition on measures of a text. On a sample of the rows each rule is timed, over
many evaluations and against one that does nothing, and its rejections are counted; then the rules
are put in one nested CASE, the rule with the most rejections per second first, so a row leaves the
cascade at the first rule that it fails and the later ones are not evaluated for it. The order
changes the cost only: a row is kept if it passes all rules, in any order.

`assess` returns the measures of the base rules, so it computes them for every row. `keep_good` has
the base rules in the cascade, with all measures but counts of words and characters computed in the
rules that ask for them, and repeated words counted only where distinct windows leave it open.

Defined results: words are runs of characters other than blanks, tabs and line ends; null and
empty texts have none and fail the base rules; repeated rows, null ids and ties are treated row by
row; an empty table gives no row, in the order the rules are given; other columns are kept by
`keep_good` and ignored by `measure`. Windows of words are compared by 64-bit hashes. Letters
include the marks on them, and words may be long in scripts without blanks between words. A very
long text is one row, whose words and windows a task holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.columns import fresh

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which `fails` is true; `fails` gets a column by name."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


@dataclass(frozen=True)
class QualityConfig:
    min_words: int = 50
    max_repeat_percent: int = 50
    sample_rows: int = 2_000
    evaluations: int = 2  # of a rule on each sampled row
    seed: int = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    parts = F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " ")
    return F.filter(parts, lambda w: w != "")


def _windows(words: Column) -> Column:
    """Hashes of all windows of three words; there are three words at least."""
    at = F.sequence(F.lit(0), F.size(words) - 3)
    return F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more."""

    def covered(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def twice(rows: Column) -> Column:
            def alike(row: Column, i: Column) -> Column:
                before = (i > 0) & (rows[F.greatest(i - 1, F.lit(0))]["k"] == row["k"])
                last = F.size(rows) - 1
                after = (i < last) & (rows[F.least(i + 1, last)]["k"] == row["k"])
                return before | after

            return F.sort_array(F.transform(F.filter(rows, alike), lambda row: row["i"]))

        def spread(starts: Column) -> Column:
            def step(i: Column) -> Column:
                return F.least(F.lit(3), starts[i] - starts[i - 1])

            gaps = F.transform(F.sequence(F.lit(1), F.size(starts) - 1), step)
            more = F.when(F.size(starts) < 2, 0).otherwise(
                F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)
            )
            return F.when(F.size(starts) == 0, 0).otherwise(more + 3)

        some = let(ordered, lambda rows: let(twice(rows), spread))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(some)

    return F.when(F.size(words) < 4, 0).otherwise(let(_windows(words), covered))


def most_repeated_words(words: Column) -> Column:
    """No less than `repeated_words`, at less cost: every window beyond the distinct ones stands for
    two that occur twice or more at most, so for six words."""
    extra = let(_windows(words), lambda keys: F.size(keys) - F.size(F.array_distinct(keys)))
    return F.when(F.size(words) < 4, 0).otherwise(6 * extra)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACE, "") != "")
    return let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept)))


def _cheap_measures(value: Column, words: Column) -> dict[str, Column]:
    return {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(value, SPACE, "")),
        "n_symbols": F.length(value) - F.length(F.translate(value, SYMBOLS, "")),
    }


def _with_words(docs: DataFrame, text: str) -> tuple[DataFrame, Column, str]:
    """`docs` with a column of the text's words; the text without nulls, and the column's name."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = fresh(docs, "words")
    return docs.select("*", F.inline(F.array(F.struct(words_of(value).alias(words))))), value, words


def _held(df: DataFrame, names: list[str], known: dict[str, Column]) -> DataFrame:
    """`names` and measures; a one-row generator keeps these from being written out again in use."""
    columns = F.struct(*(c.cast("long").alias(n) for n, c in known.items()))
    return df.select(*names, F.inline(F.array(columns)))


def measure(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the base measures of its text column as long columns."""
    with_words, value, words = _with_words(docs, text)
    known = _cheap_measures(value, F.col(words)) | {
        "n_dup_lines": duplicate_lines(value),
        "n_repeat_words": repeated_words(F.col(words)),
    }
    return _held(with_words, docs.columns, known)


def base_failed(cfg: QualityConfig) -> Column:
    return (F.col("n_words") < cfg.min_words) | (
        100 * F.col("n_repeat_words") > cfg.max_repeat_percent * F.col("n_words")
    )


def base_rules(cfg: QualityConfig) -> tuple[Rule, ...]:
    """The conditions of `base_failed` as rules of a cascade."""

    def repeats(c: Callable[[str], Column]) -> Column:
        least = cfg.max_repeat_percent * c("n_words")
        return (100 * c("most_repeat_words") > least) & (100 * c("n_repeat_words") > least)

    few = Rule("few words", lambda c: c("n_words") < cfg.min_words)
    return few, Rule("repeated words", repeats)


# Rejections of texts that pass the base rules: each is far outside what prose looks like.
RULES = (
    Rule("symbols", lambda c: 10 * c("n_symbols") > c("n_words")),
    Rule("short words", lambda c: c("word_chars") < 2 * c("n_words")),
    Rule(
        "long words",
        lambda c: (c("word_chars") > 14 * c("n_words")) & (2 * c("n_unspaced") < c("word_chars")),
    ),
    Rule("duplicate lines", lambda c: (c("n_dup_lines") > 3) & (2 * c("n_dup_lines") > c("n_lines"))),
    Rule("bullets", lambda c: 10 * c("n_bullets") > 9 * c("n_lines")),
    Rule("letters", lambda c: 10 * c("n_letters") < 6 * c("word_chars")),
)


# Ranges of scripts without blanks between words: Thai and Lao, Burmese, Khmer, kana,
# Han with its extensions.
UNSPACED = (
    r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"
    r"\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
)


def rule_inputs(
    text: Column, measures: Callable[[str], Column], words: Column | None = None
) -> Callable[[str], Column]:
    """Measures by name: those known as given, others computed from the text where asked for."""

    def lines(keep: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(F.split(text, "\n"), keep))

    extra = {
        "n_lines": lambda: lines(lambda x: F.translate(x, SPACE, "") != ""),
        "n_bullets": lambda: lines(lambda x: x.rlike(r"^[ \t]*(?:[-*•‣]|\d+[.)])[ \t]")),
        "n_letters": lambda: F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")),
        "n_unspaced": lambda: F.length(F.regexp_replace(text, f"[^{UNSPACED}]+", "")),
    }
    if words is not None:
        extra |= {
            "n_dup_lines": lambda: duplicate_lines(text),
            "n_repeat_words": lambda: repeated_words(words),
            "most_repeat_words": lambda: most_repeated_words(words),
        }
    return lambda name: extra[name]() if name in extra else measures(name)


def rule_order(
    sample: DataFrame,
    text: Column,
    rules: Sequence[Rule],
    words: Column | None = None,
    evaluations: int = 2,
) -> list[Rule]:
    """The rules by rejections per second on the sample, most first; ties keep their order.

    The time of a rule is that of `evaluations` of it on each row, less that of a rule that rejects
    nothing at no cost, so a job's own time does not count.
    """
    rows = sample.persist()
    try:
        total = rows.count()
        again = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(evaluations))).alias("_again"))

        def timed(fails: Column) -> tuple[int, float]:
            began = time.perf_counter()
            rejected = again.agg(F.count_if(fails & F.col("_again").isNotNull())).first()[0]
            return rejected, time.perf_counter() - began

        nothing = F.lit(False)
        idle = min(timed(nothing)[1] for _ in range(2)) if total else 0.0
        worth = []
        for rule in rules if total else ():
            rejected, seconds = timed(rule.fails(rule_inputs(text, F.col, words)))
            worth.append(rejected / max(seconds - idle, 1e-3))
    finally:
        rows.unpersist()
    if not total:
        return list(rules)
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def cascade(rules: Sequence[Rule], text: Column, words: Column | None = None) -> Column:
    """The name of the first rule that a row fails, null if it passes all; lazily nested."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        fails = rule.fails(rule_inputs(text, F.col, words))
        verdict = F.when(fails, F.lit(rule.name)).otherwise(verdict)
    return verdict


def assess(
    docs: DataFrame, cfg: QualityConfig | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """doc_id, the base measures, base_failed and kept, a row per document."""
    cfg = cfg or QualityConfig()
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    value = F.coalesce("text", F.lit(""))
    sample = measure(_sample(rows, cfg), "text")
    ordered = rule_order(sample, value, rules, evaluations=cfg.evaluations)
    measured = measure(rows, "text").withColumn("base_failed", base_failed(cfg))
    kept = ~F.col("base_failed") & cascade(ordered, value).isNull()
    return measured.select("doc_id", *BASE, "base_failed", kept.alias("kept"))


def _sample(rows: DataFrame, cfg: QualityConfig) -> DataFrame:
    """About `sample_rows` rows drawn over the whole table."""
    total = rows.count()
    return rows.sample(min(1.0, cfg.sample_rows / max(total, 1)), cfg.seed)


def keep_good(
    docs: DataFrame, cfg: QualityConfig | None = None, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """The rows of `docs` that pass the base rules and the cascade, unchanged."""
    cfg = cfg or QualityConfig()

    def prepared(rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        with_words, value, words = _with_words(rows, "text")
        known = _cheap_measures(value, F.col(words))
        return _held(with_words, with_words.columns, known), value, F.col(words)

    sample, value, words = prepared(_sample(docs.select("text"), cfg))
    ordered = rule_order(sample, value, (*base_rules(cfg), *rules), words, cfg.evaluations)
    inner = fresh(docs, "row")
    nested = docs.select(F.struct(*docs.columns).alias(inner), F.col("text"))
    rows, value, words = prepared(nested)
    return rows.filter(cascade(ordered, value, words).isNull()).select(f"{inner}.*")

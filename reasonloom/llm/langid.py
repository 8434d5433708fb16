"""Languages of texts and of the spans of mixed texts.

The scripts of a word's letters narrow the languages that it may have; within them a word gets a
score per language from the words, letters and letter n-grams of the training texts. A Viterbi
pass over the words, in which a change of language costs a fixed penalty, labels spans. The
language of a text is that of the most letters under its spans, the score its share of the letters.

The model is fitted on a bounded sample of labelled rows, chosen by hash: about `max_train` rows in
equal parts for all languages, but at least `least_train` of each, so a language is learned however
rare it is. Words and n-grams are counted in Spark; the `max_features` most frequent of each
language come to the driver. Nothing but the text enters a prediction.

Defined results: `und` with score 0 for null, empty and letterless texts; repeated rows are
labelled alike; a row with a null id has the checksum 0, so it counts as held out, and is never
trained on; null languages are never trained on; without any training row all texts are `und`; an
empty table gives no row; other columns are ignored. Letters of two scripts are two words, also
without a blank between them. A very long text is cut into blocks that are chained exactly, and is
held whole by its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches, release_words
from reasonloom.session import write_once

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
NGRAMS = (1, 2, 3, 4)
# The ranges of code points of common scripts.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
MAX_WORDS = 500_000
NEVER = -60.0  # the score of a language that a word cannot have
LOW = -1e9


@dataclass(frozen=True)
class LangConfig:
    max_train: int = 5_000
    least_train: int = 200  # of each language
    max_features: int = 20_000  # of each language
    switch_penalty: float = 6.0
    folds: int = 5
    held_fold: int = 0


def has_letter(word: str) -> bool:
    """`WORD` also takes numerals that are no decimal digits, such as fractions."""
    return word.isalpha() or any(map(str.isalpha, word))


def script_of(char: str) -> str:
    code = ord(char)
    for name, first, last in SCRIPTS:
        if first <= code <= last:
            return name
    return "other"


def word_places(text: str | None) -> list[tuple[int, int]]:
    """Start and end of the words of a text: letters side by side, of one script."""
    if not text:
        return []
    found = [m.span() for m in WORD.finditer(text) if has_letter(m.group())]
    if not BEYOND_LATIN.search(text):
        return found
    out = []
    for start, end in found:
        first = start
        for k in range(start + 1, end):
            if script_of(text[k]) != script_of(text[k - 1]):
                out.append((first, k))
                first = k
        out.append((first, end))
    return [(a, b) for a, b in out if has_letter(text[a:b])]


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    lower = text.lower()
    if not BEYOND_LATIN.search(lower):
        return list(filter(has_letter, WORD.findall(lower)))
    return [lower[a:b] for a, b in word_places(lower)]


def fold(cfg: LangConfig) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % cfg.folds


class LangModel:
    """Scores of words per language, and the best labelling of a text's words."""

    def __init__(
        self,
        langs: list[str],
        scripts: dict[str, set[int]],
        grams: dict[str, list[float]],
        penalty: float,
    ):
        self.langs, self.scripts, self.penalty = langs, scripts, penalty
        self.rows = {gram: k + 1 for k, gram in enumerate(grams)}
        self.odds = np.vstack([np.zeros((1, len(langs))), *(np.array([g]) for g in grams.values())])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.langs)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _allowed(self, word: str) -> np.ndarray:
        """Zero for the languages that use a script of the word, far below for the others."""
        names = {"latin"} if word.isascii() else {script_of(c) for c in word}
        users = set().union(*(self.scripts.get(n, ()) for n in names))
        out = np.zeros(len(self.langs))
        if users:
            out[[k for k in range(len(self.langs)) if k not in users]] = NEVER
        return out

    def _learn(self, words: list[str]) -> None:
        """Scores of new words: log-likelihoods per language, zero for the best."""
        found, sizes = [], []
        for word in words:
            features = features_of(word)
            found += [self.rows.get(f, 0) for f in features]
            sizes.append(len(features))
        starts = np.cumsum(sizes) - sizes
        scores = np.add.reduceat(self.odds[found], starts, axis=0) / len(NGRAMS)
        scores += np.array([self._allowed(w) for w in words])
        scores = np.maximum(scores - scores.max(axis=1, keepdims=True), NEVER)
        self.known.update(zip(words, range(len(self.scores), len(self.scores) + len(words)), strict=True))
        self.scores = np.vstack([self.scores, scores])

    def word_scores(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > MAX_WORDS:
            self._forget()
            new = set(words)
        if new:
            self._learn(sorted(new))
        return self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of every word of each text."""
        words = [w for text in texts for w in text]
        if not words or not self.langs:
            return [np.zeros(len(text), np.int64) for text in texts]
        lengths = np.array([len(t) for t in texts])
        path = best_paths(self.word_scores(words), lengths, self.penalty)
        return np.split(path, np.cumsum(lengths)[:-1])

    def summary(self, words: list[str], labels: np.ndarray) -> tuple[str, float]:
        """The language of most letters, ties to the first name, and its share of the letters."""
        if not words or not self.langs:
            return UNKNOWN, 0.0
        letters = np.bincount(labels, [len(w) for w in words], len(self.langs))
        top = int(letters.argmax())
        return self.langs[top], float(letters[top] / letters.sum())


def features_of(word: str) -> list[str]:
    """The word itself, its letters, and the n-grams of the word with marked ends."""
    padded = f"^{word}$"
    grams = [padded[i : i + n] for n in NGRAMS for i in range(len(padded) - n + 1)]
    return [f"={word}", *word, *grams]


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float, size: int = 128) -> np.ndarray:
    """Viterbi paths of many texts, whose words' scores follow each other.

    Texts are cut into blocks of `size` words that step together. A block's matrix holds the best
    score from each language before it to each language of its last word; the matrices of a text
    are chained, which fixes the languages at the ends of all blocks, and then all blocks are
    walked back at once. The result is that of one pass over each whole text.
    """
    n_langs = scores.shape[1]
    n_blocks = -(-lengths // size)
    text_of = np.repeat(np.arange(len(lengths)), n_blocks)
    rank = np.arange(len(text_of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = (np.cumsum(lengths) - lengths)[text_of] + rank * size
    width = np.minimum(size, lengths[text_of] - rank * size)

    order = np.argsort(-width, kind="stable")  # long blocks first: those with a word t are a prefix
    begin, width = begin[order], width[order]
    alive = np.searchsorted(-width, -np.arange(1, size + 1), "right")
    alive = alive[alive > 0]

    def forward(value: np.ndarray, keep_pointers: bool):
        """`value`: (blocks, entries, languages) before the first word of each block."""
        stays, tops = [], []
        for t, n in enumerate(alive.tolist()):
            before = value[:n]
            switch = before.max(axis=2, keepdims=True) - penalty
            if keep_pointers:
                stays.append(before[:, 0] >= switch[:, 0])
                tops.append(before[:, 0].argmax(axis=1))
            value[:n] = np.maximum(before, switch) + scores[begin[:n] + t][:, None, :]
        return value, stays, tops

    start = np.full((len(begin), n_langs, n_langs), LOW)
    start[:, np.arange(n_langs), np.arange(n_langs)] = 0.0
    matrices, _, _ = forward(start, keep_pointers=False)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # of a block, in reading order, among the sorted ones
    entry, leave = _chain(matrices[place], n_blocks)

    known = np.full((len(begin), 1, n_langs), LOW)
    known[np.arange(len(begin)), 0, entry[order]] = 0.0
    _, stays, tops = forward(known, keep_pointers=True)
    path = np.zeros(len(scores), np.int64)
    state = leave[order].copy()
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        rows = np.arange(n)
        path[begin[:n] + t] = state[:n]
        state[:n] = np.where(stays[t][rows, state[:n]], state[:n], tops[t])
    return path


def _chain(matrices: np.ndarray, n_blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language before each block and that of its last word, blocks in reading order."""
    first = np.cumsum(n_blocks) - n_blocks
    n_langs = matrices.shape[1]
    value = np.zeros((len(n_blocks), n_langs))
    came = np.zeros((len(matrices), n_langs), np.int64)
    longest = int(n_blocks.max()) if len(n_blocks) else 0
    for k in range(longest):
        texts = np.flatnonzero(n_blocks > k)
        through = value[texts][:, :, None] + matrices[first[texts] + k]
        came[first[texts] + k] = through.argmax(axis=1)
        value[texts] = through.max(axis=1)
    leave = np.zeros(len(matrices), np.int64)
    entry = np.zeros(len(matrices), np.int64)
    state = value.argmax(axis=1)
    for k in range(longest - 1, -1, -1):
        texts = np.flatnonzero(n_blocks > k)
        at = first[texts] + k
        leave[at] = state[texts]
        entry[at] = state[texts] = came[at, state[texts]]
    return entry, leave


def sample_shares(counts: dict[str, int], cfg: LangConfig) -> dict[str, float]:
    """The share of each language's labelled rows that is learned from."""
    most = max(cfg.least_train, cfg.max_train // max(len(counts), 1))
    return {lang: min(1.0, most / n) for lang, n in counts.items()}


def training_words(docs: DataFrame, cfg: LangConfig) -> DataFrame:
    """lang, word, n of the bounded sample of labelled rows."""
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string"),
        F.col("lang").cast("string"),
    ).filter("doc_id is not null and text is not null and lang is not null")
    usable = usable.filter(fold(cfg) != cfg.held_fold)
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return usable.select("lang", F.col("text").alias("word"), F.lit(0).cast("long").alias("n")).limit(0)
    shares = sample_shares(counts, cfg)
    share = F.create_map(*(F.lit(x) for item in shares.items() for x in item))[F.col("lang")]
    # 53 bits of the hash as a fraction: exact at any number of rows
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11).cast("double") / float(1 << 53)
    some = usable.filter(place < share)
    letters = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("letters")
    return _one_script(some.select("lang", letters)).groupBy("lang", "word").agg(F.count("*").alias("n"))


def _one_script(rows: DataFrame) -> DataFrame:
    """lang, letters -> lang, word: letters cut where the script changes."""
    ranges = [rf"[\x{{{first:X}}}-\x{{{last:X}}}]+" for _, first, last in SCRIPTS]
    others = "".join(rf"\x{{{first:X}}}-\x{{{last:X}}}" for _, first, last in SCRIPTS)
    pattern = "|".join([*ranges, f"[^{others}]+"])
    plain = F.col("letters").rlike(r"^[\x{0}-\x{24F}]+$")
    parts = F.when(plain, F.array("letters")).otherwise(
        F.regexp_extract_all("letters", F.lit(f"({pattern})"), 1)
    )
    return rows.select("lang", F.explode(parts).alias("word"))


def fit(docs: DataFrame, cfg: LangConfig | None = None) -> LangModel:
    cfg = cfg or LangConfig()
    words = write_once(training_words(docs, cfg), "training-words")
    langs = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return LangModel([], {}, {}, cfg.switch_penalty)
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = [F.array(F.concat(F.lit("="), "word")), F.split("word", "")]
    for n in NGRAMS:
        grams.append(_grams(padded, n))
    gram = F.explode(F.concat(*grams)).alias("gram")
    numbers = [F.when(F.col("lang") == lang, F.col("n")) for lang in langs]
    per_lang = [F.coalesce(F.sum(n), F.lit(0)).alias(f"n{k}") for k, n in enumerate(numbers)]
    counted = words.select("lang", "n", gram).groupBy("gram").agg(F.sum("n").alias("total"), *per_lang)
    counted = write_once(counted.filter("total >= 3"), "grams")
    # the most frequent of each language; a task ranks the n-grams of a bounded sample
    pairs = [F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n")) for k in range(len(langs))]
    each = counted.select("gram", F.explode(F.array(*pairs)).alias("p")).filter("p.n > 0")
    order = Window.partitionBy("p.k").orderBy(F.desc("p.n"), "gram")
    kept = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.max_features)
    rows = counted.join(kept.select("gram").distinct(), "gram").orderBy("gram").collect()
    counts = np.array([[r[f"n{k}"] for k in range(len(langs))] for r in rows], float)
    counts = counts.reshape(len(rows), len(langs))
    shares = (counts + 0.5) / (counts.sum(axis=0) + 0.5 * max(len(rows), 1))
    odds = np.log(shares) - np.log(shares).mean(axis=1, keepdims=True)
    letters = {r["gram"]: c for r, c in zip(rows, counts, strict=True) if len(r["gram"]) == 1}
    scripts: dict[str, set[int]] = {}
    for char, count in letters.items():
        scripts.setdefault(script_of(char), set()).update(np.flatnonzero(count).tolist())
    grams_found = {r["gram"]: o.tolist() for r, o in zip(rows, odds, strict=True)}
    return LangModel(langs, scripts, grams_found, cfg.switch_penalty)


def _grams(padded: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.length(padded) - (n - 1))
    windows = F.transform(at, lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.length(padded) < n, F.array().cast("array<string>")).otherwise(windows)


def predict(docs: DataFrame, model: LangModel, cfg: LangConfig | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`."""
    cfg = cfg or LangConfig()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                ids, held, texts = zip(*group, strict=True)
                words = [words_of(t) for t in texts]
                found = [model.summary(w, p) for w, p in zip(words, model.label(words), strict=True)]
                langs, scores = zip(*found, strict=True)
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array(held, pa.bool_()),
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(
        F.col("doc_id").cast("long"),
        (fold(cfg) == cfg.held_fold).alias("held_out"),
        F.col("text").cast("string"),
    )
    return rows.mapInArrow(apply, "doc_id long, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id and the text's spans: start and end in code points, and the language."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                found = [word_places(t) for _, t in group]
                words = [[t[a:b].lower() for a, b in ms] for (_, t), ms in zip(group, found, strict=True)]
                labels = model.label(words)
                out = [_runs(ms, p, model.langs) for ms, p in zip(found, labels, strict=True)]
                columns = [pa.array([d for d, _ in group], pa.int64()), pa.array(out, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(apply, "doc_id long, spans array<struct<start:long,end:long,lang:string>>")


def _runs(places: list[tuple[int, int]], labels: np.ndarray, langs: list[str]) -> list[dict]:
    out: list[dict] = []
    for (start, end), label in zip(places, labels.tolist(), strict=True):
        lang = langs[label] if langs else UNKNOWN
        if out and out[-1]["lang"] == lang:
            out[-1]["end"] = end
        else:
            out.append({"start": start, "end": end, "lang": lang})
    return out

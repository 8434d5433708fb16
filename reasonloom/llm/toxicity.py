"""Toxicity scores by weak supervision.

Many voters look at a text: groups of insults per language, families of word beginnings that the
labelled training rows single out, and patterns. A generative label model estimates from the
training rows how often each voter speaks for either class, the given label being one more voter,
and how strongly voters are correlated beyond the class; correlated voters share their weight.
Its posterior labels train a linear classifier on the voters' counts, which scores every text.

The training rows are a bounded sample, `max_train` rows of least hash; only they, at most
`max_features` learned word beginnings, and their vote counts reach the driver. Nothing but the
text enters a score.

Defined results: null and empty texts get a score; repeated rows are scored alike; a row with a
null id counts as a training row (`held_out` false) but is never labelled; contradictory labels of
one id are averaged; null labels are left out; without any labelled row the fixed words alone
decide; an empty table gives no row; other columns are ignored; training rows of equal hashes are
ordered by id, word beginnings of equal gain by name. A very long text is held whole by its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reasonloom.llm.tokens import arrow_rows, char_batches, release_words
from reasonloom.session import write_once

# Insults, by language, in groups of which each is a voter.
INSULTS = {
    "en mind": "idiot moron stupid imbecile dumb dumbass halfwit cretin braindead",
    "en worth": "loser worthless pathetic useless failure nobody",
    "en dirt": "scum trash filth vermin garbage disgusting",
    "en mock": "clown freak creep jerk bastard coward",
    "de kopf": "idiot idioten dummkopf trottel blödmann schwachkopf vollidiot dumm",
    "de wert": "versager abschaum dreckskerl nichtsnutz erbärmlich wertlos widerlich",
    "fr tête": "idiot idiote imbécile crétin crétine débile abruti abrutie stupide",
    "fr valeur": "ordure pathétique minable raté salaud pourriture dégoûtant",
    "es cabeza": "idiota imbécil estúpido estúpida tonto tarado cretino",
    "es valor": "basura patético escoria inútil asqueroso asquerosa miserable",
}
PATTERNS = {
    "addressed": r"\byou(?:'re| are)(?: such)? (?:an?|the)? ?\w*(?:idiot|moron|loser|scum|trash|clown)",
    "threat": r"\b(?:kill|hurt) (?:yourself|you)\b|\bgo (?:and )?die\b",
    "shut up": r"\bshut up\b|\bhalt die klappe\b|\bferme[- ]la\b|\bc[aá]llate\b",
}
WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7)
STEPS = (1, 2, 3, 5)  # numbers of words at which the classifier has a column of its own
PLAIN_WORDS = 400_000


@dataclass(frozen=True)
class ToxicConfig:
    max_train: int = 10_000
    max_features: int = 4_000
    min_gain: float = 30.0  # twice the log-likelihood ratio of a learned word beginning
    min_log_odds: float = 1.0
    families: int = 40
    threshold: float = 0.7
    folds: int = 3
    held_fold: int = 1


def fold(cfg: ToxicConfig) -> Column:
    """The remainder that tells training rows from held-out ones."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % cfg.folds


@dataclass
class Voters:
    """Counts, for a text, the distinct words that speak for each voter."""

    learned: dict[str, tuple[int, float]] = field(default_factory=dict)
    n_families: int = 0

    def __post_init__(self) -> None:
        self.fixed: dict[str, list[int]] = {}
        for k, words in enumerate(INSULTS.values()):
            for word in words.split():
                self.fixed.setdefault(word, []).append(k)
        self.patterns = [re.compile(p) for p in PATTERNS.values()]
        self.first_learned = len(INSULTS) + len(self.patterns)
        self.n_voters = self.first_learned + self.n_families
        self.n_columns = self.n_voters + 3
        self.plain: set[str] = set()

    def _hits(self, word: str) -> tuple[list[int], float]:
        voters, odds = list(self.fixed.get(word, ())), 0.0
        for key in (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)):
            if key in self.learned:
                family, value = self.learned[key]
                voters.append(self.first_learned + family)
                odds = max(odds, value)
        return voters, odds

    def counts(self, text: str | None) -> np.ndarray:
        """Per voter the number of words; then words with any hit, evidence, log of all words."""
        out = np.zeros(self.n_columns)
        if not text:
            return out
        text = text.lower()
        words = WORD.findall(text)
        if len(self.plain) > PLAIN_WORDS:
            self.plain.clear()
        for word in set(words).difference(self.plain):
            voters, odds = self._hits(word)
            if not voters:
                self.plain.add(word)
                continue
            out[list(set(voters))] += 1
            out[self.n_voters] += 1
            out[self.n_voters + 1] += odds
        for k, pattern in enumerate(self.patterns):
            out[len(INSULTS) + k] = pattern.search(text) is not None
        out[self.n_voters + 2] = np.log1p(len(words))
        return out

    def fires(self, counts: np.ndarray) -> np.ndarray:
        """Who votes for toxic: a fixed voter at one word, a learned family at two."""
        least = np.where(np.arange(self.n_voters) < self.first_learned, 1, 2)
        return counts[:, : self.n_voters] >= least

    def __getstate__(self) -> dict:
        return {"learned": self.learned, "n_families": self.n_families}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)


@dataclass
class LabelModel:
    """Latent-class model of the votes, with weights that discount correlated voters.

    The given label takes part as the last voter; a voter silent on nearly all rows takes none.
    """

    rounds: int = 30
    tolerated: float = 0.1
    least_fires: int = 3

    def fit(self, fires: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row; `label` is 0, 1 or nan."""
        self.live = np.flatnonzero(fires.sum(axis=0) >= self.least_fires)
        known = ~np.isnan(label)
        given = np.nan_to_num(label, nan=0.0)
        votes = np.column_stack([fires[:, self.live], given]).astype(float)
        seen = np.ones(votes.shape)
        seen[:, -1] = known
        post = np.where(known, 0.05 + 0.9 * given, np.where(fires.any(axis=1), 0.9, 0.05))
        self.weight = np.ones(votes.shape[1])
        for _ in range(self.rounds):
            self.prior = (post.sum() + 1) / (len(post) + 2)
            self.in_toxic = self._rates(votes, seen, post, expected_label=0.95)
            self.in_clean = self._rates(votes, seen, 1 - post, expected_label=0.05)
            self.weight = self._shares(votes, post)
            post = self._posterior(votes, seen)
        return post

    @staticmethod
    def _rates(votes, seen, share, expected_label: float) -> np.ndarray:
        guess = np.full(votes.shape[1], 0.02)
        guess[-1] = expected_label
        return ((votes * seen).T @ share + 10 * guess) / (seen.T @ share + 10)

    def _shares(self, votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """A voter's part of the weight that it shares with voters of like residuals."""
        expected = np.outer(post, self.in_toxic) + np.outer(1 - post, self.in_clean)
        rest = (votes - expected)[:, :-1]
        scale = np.sqrt((rest**2).sum(axis=0))
        self.correlation = (rest.T @ rest) / np.maximum(np.outer(scale, scale), 1e-9)
        np.fill_diagonal(self.correlation, 0)
        shared = np.maximum(self.correlation - self.tolerated, 0).sum(axis=0)
        return np.append(1 / (1 + shared), 1.0)

    def _posterior(self, votes: np.ndarray, seen: np.ndarray) -> np.ndarray:
        speaks = np.log(self.in_toxic / self.in_clean)
        silent = np.log((1 - self.in_toxic) / (1 - self.in_clean))
        evidence = (votes * speaks + (1 - votes) * silent) * seen
        logit = np.log(self.prior / (1 - self.prior)) + evidence @ self.weight
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def design(counts: np.ndarray) -> np.ndarray:
    """Columns of the linear classifier: one, steps of the counts and of the evidence, totals."""
    votes, evidence, totals = counts[:, :-2], counts[:, -2:-1], np.log1p(counts[:, -3:-1])
    steps = [votes >= step for step in STEPS] + [evidence >= 2 * step for step in STEPS]
    return np.column_stack([np.ones(len(counts)), *steps, totals, counts[:, -1] / 10])


def fit_linear(columns: np.ndarray, target: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method."""
    weights = np.zeros(columns.shape[1])
    penalty = np.full(len(weights), ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(columns @ weights, -30, 30)))
        gradient = columns.T @ (p - target) + penalty * weights
        hessian = (columns.T * (p * (1 - p))) @ columns + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        weights -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return weights


@dataclass
class ToxicModel:
    voters: Voters
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        counts = np.array([self.voters.counts(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(design(counts) @ self.weights, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig) -> DataFrame:
    """doc_id, text, toxic (0 to 1) of the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("toxic"))
    usable = known.filter("doc_id is not null and toxic is not null").filter(
        fold(cfg) != cfg.held_fold
    )
    merged = usable.groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    some = merged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.max_train)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = texts.join(F.broadcast(some), "doc_id")  # at most max_train rows of two numbers
    return found.dropDuplicates(["doc_id"])


def _beginnings(words: Column, k: int) -> Column:
    longer = F.filter(words, lambda w: F.length(w) > k)
    return F.transform(longer, lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def learn_voters(train: DataFrame, cfg: ToxicConfig) -> Voters:
    """Word beginnings much more frequent in toxic training texts, in families of four letters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1))
    keys = [words] + [_beginnings(words, k) for k in PREFIXES]
    feature = F.explode(F.array_distinct(F.flatten(F.array(*keys)))).alias("feature")
    toxic = (F.col("toxic") >= 0.5).cast("long")
    row = train.agg(F.sum(toxic).alias("toxic"), F.count("*").alias("all")).first()
    n1, n0 = row["toxic"] or 0, row["all"] - (row["toxic"] or 0)
    if not n1 or not n0:
        return Voters()
    counted = train.select(toxic.alias("y"), feature).groupBy("feature").agg(
        F.sum("y").alias("k1"), (F.count("*") - F.sum("y")).alias("k0")
    )
    total, share = F.col("k1") + F.col("k0"), n1 / (n1 + n0)

    def part(k: str, rate: float) -> Column:
        return F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (total * rate))).otherwise(0.0)

    odds = F.log(((F.col("k1") + 0.5) / (n1 + 1)) / ((F.col("k0") + 0.5) / (n0 + 1)))
    gain = 2 * (part("k1", share) + part("k0", 1 - share))
    scored = counted.select("feature", odds.alias("odds"), gain.alias("gain"))
    found = (
        scored.filter((F.col("gain") >= cfg.min_gain) & (F.col("odds") >= cfg.min_log_odds))
        .orderBy(F.desc("gain"), "feature")
        .limit(cfg.max_features)
        .collect()
    )
    families: dict[str, int] = {}
    learned = {}
    for feature, value, _ in found:
        name = feature[:4]
        if name not in families:
            families[name] = min(len(families), cfg.families - 1)
        learned[feature] = (families[name], float(value))
    return Voters(learned, min(len(families), cfg.families))


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig | None = None) -> ToxicModel:
    cfg = cfg or ToxicConfig()
    train = write_once(training_rows(docs, labels, cfg), "toxic-training")
    voters = learn_voters(train, cfg)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, toxic = (batch.column(i) for i in (0, 2))
            counts = [voters.counts(t).tolist() for t in batch.column(1).to_pylist()]
            column = pa.array(counts, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, toxic, column], ["doc_id", "toxic", "counts"])

    counted = train.select("doc_id", "text", F.col("toxic").cast("double"))
    rows = counted.mapInArrow(count, "doc_id long, toxic double, counts array<double>").collect()
    if not rows:
        # the fixed words alone: a score of 0.7 takes one of them in a text of common length
        weights = np.zeros(len(STEPS) * (voters.n_voters + 2) + 4)
        weights[[0, -3]] = -4.0, 8.0
        return ToxicModel(voters, weights)
    rows.sort()
    counts = np.array([r["counts"] for r in rows])
    label = np.array([r["toxic"] for r in rows]).round()
    posterior = LabelModel().fit(voters.fires(counts), label)
    return ToxicModel(voters, fit_linear(design(counts), posterior))


def score(docs: DataFrame, model: ToxicModel, cfg: ToxicConfig | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`."""
    cfg = cfg or ToxicConfig()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_words()
        for batch in batches:
            for group in char_batches(arrow_rows(batch)):
                ids, held, texts = zip(*group, strict=True)
                columns = [
                    pa.array(ids, pa.int64()),
                    pa.array(held, pa.bool_()),
                    pa.array(model.scores(list(texts))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col("doc_id").cast("long"),
        (fold(cfg) == cfg.held_fold).alias("held_out"),
        F.col("text").cast("string"),
    )
    scored = rows.mapInArrow(apply, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cfg.threshold).cast("int"))


def keep_clean(docs: DataFrame, model: ToxicModel, cfg: ToxicConfig | None = None) -> DataFrame:
    """The rows of `docs` that are not predicted to be toxic, unchanged."""
    cfg = cfg or ToxicConfig()

    @F.pandas_udf("double")
    def value(texts: pd.Series) -> pd.Series:
        release_words()
        out = [model.scores([t for (t,) in group]) for group in char_batches((t,) for t in texts)]
        return pd.Series(np.concatenate(out) if out else [], texts.index, float)

    return docs.filter(value(F.col("text").cast("string")) < cfg.threshold)

"""Token ids of whole texts, word by word with a bounded memory of seen words."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa

BATCH_CHARS = 2_000_000
MAX_WORDS = 1_000_000
LAST = "\xff"  # of Latin-1
MARKS = frozenset(",.;:!?|")


def arrow_rows(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple]:
    """The rows of an Arrow batch, of which only a slice at a time is made of Python objects."""
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def char_batches(rows: Iterable[tuple], size: int = BATCH_CHARS) -> Iterator[list[tuple]]:
    """Group rows whose last item is a text, so that a group holds about `size` characters."""
    group, chars = [], 0
    for row in rows:
        group.append(row)
        chars += len(row[-1] or "") + 1
        if chars >= size:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _folded(text: str) -> str:
    """Lower case where that is certain to be what the tokenizer does itself: within Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text if "<|" in text else text.lower()


class WordEncoder:
    """Encodes texts with a tokenizer whose tokens never cross a blank or a line feed.

    That holds for `word_bpe_49k.json`: it drops white space and splits at it, and its
    normalizations do not reach over a blank. It also folds case and splits letters from
    punctuation, so a Latin-1 word of letters with one mark behind it is the word and the mark. Words
    repeat, so each is encoded once while it is remembered; when more than `max_words` would be
    remembered, the words seen least are forgotten.
    """

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.seen = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the words seen most, half of the memory at most."""
        least = 2
        while (self.seen >= least).sum() > self.max_words // 2:
            least *= 2
        kept = np.flatnonzero(self.seen >= least)
        words, seen = list(self.index), self.seen[kept] // 2
        ids, _ = self._ids(kept)
        lengths = self.lengths[kept]
        self._clear()
        self._add([words[k] for k in kept.tolist()], ids, lengths)
        self.seen[:] = seen

    def _add(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        known = len(self.index)
        ends = np.cumsum(lengths) + len(self.flat)
        self.index.update(zip(words, range(known, known + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def _look_up(self, words: list[str]) -> np.ndarray:
        if len(words) < 2:
            return np.array([self.index[w] for w in words], np.int64)
        return np.array(itemgetter(*words)(self.index), np.int64)

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at these places, and the end of each word among them."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        inside = np.arange(total) + np.repeat(self.starts[at] - ends + lengths, lengths)
        return self.flat[inside], ends

    def _learn(self, words: set[str]) -> None:
        marked = [w for w in words if w[-1:] in MARKS and w[:-1].isalpha() and max(w) <= LAST]
        plain = words.difference(marked).union([w[:-1] for w in marked], [w[-1] for w in marked])
        plain = list(plain.difference(self.index))
        found = [e.ids for e in self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self._add(plain, flat, lengths)
        both = self._look_up([part for w in marked for part in (w[:-1], w[-1])])
        ids, ends = self._ids(both)
        self._add(marked, ids, np.diff(ends[1::2], prepend=0))

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers; a null text has none."""
        split = [_folded(t).replace("\n", " ").split(" ") if t else [] for t in texts]
        words = list(chain.from_iterable(split))
        unknown = set(words).difference(self.index)
        if len(self.index) + len(unknown) > self.max_words:
            self._forget()
            unknown = set(words).difference(self.index)
        if unknown:
            self._learn(unknown)
        at = self._look_up(words)
        self.seen += np.bincount(at, minlength=len(self.seen))
        ids, ends = self._ids(at)
        text_ends = np.cumsum([len(text) for text in split], dtype=np.int64)
        cuts = np.concatenate([[0], ends])[text_ends] if len(split) else []
        return np.split(ids, cuts[:-1]) if len(split) else []


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs, so that words stay remembered."""
    return WordEncoder(path)


def release_words() -> None:
    """Drop what `shared_encoder` remembers: for tasks of other work in the same Python worker."""
    shared_encoder.cache_clear()
    pa.default_memory_pool().release_unused()

"""Tokenizers of the caller, text by text or in batches."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# text -> (token, start, end), in text order
Tokenizer = Callable[[str], list[tuple[str, int, int]]]
SPAN_LISTS = "struct<token: array<string>, s: array<int>, e: array<int>>"
BATCH_CHARS = 1_000_000
_LOADED: dict[Callable, Any] = {}  # the encoder of each loader, in a Python worker


@dataclass(frozen=True)
class BatchTokenizer:
    """A tokenizer that encodes many texts at once.

    `load` makes the encoder, once in each Python worker: an object with `encode_batch(texts,
    add_special_tokens=...)` whose results have `tokens` and `offsets`, as those of the public
    tokenizers library have. With `special` the special tokens are added to a full text, never to
    a prompt or a text whose tokens are counted.
    """

    load: Callable[[], Any]
    special: bool = True

    @staticmethod
    def from_file(path: str, special: bool = True) -> BatchTokenizer:
        """A tokenizer in the library's JSON format; the path must be readable on executors."""
        return BatchTokenizer(_FromFile(path), special)

    def encode(self, texts: Sequence[str], special: bool) -> list:
        if self.load not in _LOADED:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks
            _LOADED[self.load] = self.load()
        return _LOADED[self.load].encode_batch(list(texts), add_special_tokens=special)


@dataclass(frozen=True)
class _FromFile:
    path: str

    def __call__(self) -> Any:
        from tokenizers import Tokenizer as Library

        return Library.from_file(self.path)


def _by_chars(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    """Slices of about a million characters, so that few encodings are held at once."""
    start, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text)
        if chars >= BATCH_CHARS:
            yield texts[start : k + 1]
            start, chars = k + 1, 0
    if start < len(texts):
        yield texts[start:]


def _span_lists(encoded: list, most: int) -> pa.StructArray:
    """Tokens, starts and ends as lists in Arrow memory; no object for a token but its text."""
    sizes = [min(most, len(e.tokens)) for e in encoded]
    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    token = pa.array(chain.from_iterable(e.tokens[:most] for e in encoded), pa.string())
    pairs = [np.array(e.offsets[:most], np.int32).reshape(-1, 2) for e in encoded]
    places = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int32)
    columns = [token, pa.array(places[:, 0]), pa.array(places[:, 1])]
    lists = [pa.ListArray.from_arrays(ends, c) for c in columns]
    return pa.StructArray.from_arrays(lists, ["token", "s", "e"])


def batch_spans(tokenizer: BatchTokenizer, most: int) -> Callable[[Column], Column]:
    """array<struct<token, s, e>> of at most `most` tokens; null for a null text."""

    @arrow_udf(SPAN_LISTS)
    def spans(texts: pa.Array) -> pa.Array:
        found = texts.to_pylist()
        parts = [
            _span_lists(tokenizer.encode(some, tokenizer.special), most) for some in _by_chars(found)
        ]
        return pa.concat_arrays(parts) if parts else _span_lists([], most)

    def column(text: Column) -> Column:
        lists = spans(F.coalesce(text, F.lit("")))
        zipped = F.arrays_zip(lists["token"].alias("token"), lists["s"].alias("s"), lists["e"].alias("e"))
        return F.when(text.isNotNull(), zipped)

    return column


def batch_count(tokenizer: BatchTokenizer) -> Callable[[Column], Column]:
    """How many tokens a text has without special ones; a null text has none."""

    @arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        sizes = [len(e.tokens) for some in _by_chars(texts.to_pylist()) for e in tokenizer.encode(some, False)]
        return pa.array(sizes, pa.int32())

    return lambda text: count(F.coalesce(text, F.lit("")))

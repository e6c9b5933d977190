"""Byte-level BPE encoding of a corpus with the vocabulary of a public tokenizer.

Each piece of the split text is merged with a priority queue of merge ranks over a doubly linked list of symbols:
the least rank (leftmost first) is merged, its neighbours are queued anew, and entries whose symbols have since been
merged are stale and skipped. Work and memory for a piece of n bytes are n log n and n, so very long texts are no
special case. Nothing is trained and no file is copied: the vocabulary's place is a parameter.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces remembered by a Python worker, and the longest piece it remembers.
CACHE_PIECES, CACHE_BYTES = 200_000, 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Encoding and decoding by a table of byte strings and their ranks (which are their ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.strings = {i: s for s, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self._cache: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, width = heapq.heappop(queue)
            a = symbol[i]
            j = right[i] if a is not None else -1
            if j < 0 or len(a) + len(symbol[j]) != width:
                continue  # stale: one of the two was merged since
            merged = a + symbol[j]
            symbol[i], symbol[j] = merged, None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get(merged + symbol[k])) is not None:
                    heapq.heappush(queue, (r, i, len(merged) + len(symbol[k])))
            h = left[i]
            if h >= 0 and (r := ranks.get(symbol[h] + merged)) is not None:
                heapq.heappush(queue, (r, h, len(symbol[h]) + len(merged)))
        out, i = [], 0
        while i >= 0:
            out.append(ranks[symbol[i]])
            i = right[i]
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, none for an empty or null one. Strings of special tokens are ordinary text."""
        out: list[int] = []
        if not text:
            return out
        cache = self._cache
        for m in self.split.finditer(text):
            piece = m[0]
            ids = cache.get(piece)
            if ids is None:
                ids = tuple(self.merge(piece.encode("utf-8", "replace")))
                if len(piece) <= CACHE_BYTES:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: their byte strings put together."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The encoder of a ``.tiktoken`` file (lines of a base64 string and its rank); once a process."""
    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return Encoder(ranks, public_tokenizers.PATTERN)


def encode(text: Column, path: str | None = None) -> Column:
    """The ids (array<int>) of a text by the vocabulary at ``path``; an empty list for null and empty texts."""
    at = path or vocabulary_path()

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(at)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], dtype=object)

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """The number of ids (int) of a text, 0 for null and empty ones; the ids themselves never leave the task."""
    at = path or vocabulary_path()

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(at)
        for texts in batches:
            yield pd.Series([len(e.encode(t)) for t in texts], dtype="int32")

    return count(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids; null for null."""
    at = path or vocabulary_path()

    @F.pandas_udf(T.StringType())
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(at)
        for rows in batches:
            yield pd.Series([None if r is None else e.decode(r) for r in rows], dtype=object)

    return text(ids)

"""The boundary to models: chunks of messages go to a provider, failed chunks stay apart, embeddings come back as arrays.

The provider that is built in is deterministic and works offline: it reads statuses off plain words.
"""

from __future__ import annotations

import json
import re
import time
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Extract = Callable[[list[dict]], list[dict]]
_SIGNS = (("blocked", re.compile(r"\bblocked\b|\bbloque|\bblockiert\b", re.I)), ("at_risk", re.compile(r"\brisk\b|\bpostpone", re.I)), ("on_track", re.compile(r"\bon track\b|\bdone\b", re.I)))


def offline_extract(messages: list[dict]) -> list[dict]:
    """Status items of messages (id, text): the first sign of a status, with the sentence as evidence."""
    out = []
    for m in messages:
        for sentence in re.split(r"(?<=[.!?])\s+|\n+", m["text"] or ""):
            for status, sign in _SIGNS:
                if sign.search(sentence):
                    out.append({"artifact_id": m["id"], "status": status, "span": sentence.strip()})
                    break
    return out


def extract_in_chunks(messages: DataFrame, size: int = 40, provider: Extract = offline_extract) -> DataFrame:
    """chunk, artifact_id, status, span, error: the provider's items of chunks of at most ``size`` rows (id, text) of one task.

    A chunk that fails gives one row with its error and loses no other chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size].to_dict("records")
                chunk = part[0]["id"] or ""
                try:
                    rows += [(chunk, i["artifact_id"], i["status"], i["span"], None) for i in provider(part)]
                except Exception as e:  # noqa: BLE001
                    rows.append((chunk, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["chunk", "artifact_id", "status", "span", "error"])

    return messages.select("id", "text").mapInPandas(run, "chunk string, artifact_id string, status string, span string, error string")


def extract_by_chunk(messages: DataFrame, provider: Extract = offline_extract) -> DataFrame:
    """chunk, artifact_id, status, span, error: the provider's items of each chunk of messages (chunk, id, text), in order of ids.

    Chunks are small and of fixed size, so one is a group of one task. A chunk that fails gives one row with its error
    and loses no other chunk.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        chunk = part["chunk"].iloc[0]
        try:
            rows = [(chunk, i["artifact_id"], i["status"], i["span"], None) for i in provider(part.sort_values("id")[["id", "text"]].to_dict("records"))]
        except Exception as e:  # noqa: BLE001
            rows = [(chunk, None, None, None, f"{type(e).__name__}: {e}")]
        return pd.DataFrame(rows, columns=["chunk", "artifact_id", "status", "span", "error"])

    return messages.select("chunk", "id", "text").groupBy("chunk").applyInPandas(run, "chunk bigint, artifact_id string, status string, span string, error string")


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A unit vector (array<float>) from the words of a text by a stable hash; zeros for null and empty texts."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                v = np.zeros(size, "float32")
                for w in re.findall(r"\w+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    v[h % size] += 1.0 if h & 1024 else -1.0
                out.append(v / max(float(np.linalg.norm(v)), 1e-9))
            yield pd.Series(out)

    return embed(text)


class Unavailable(Exception):
    """A provider's refusal; ``kind`` is ``rate`` (wait), ``quota`` (take the next provider) or ``server`` (try again)."""

    def __init__(self, kind: str, wait: float = 0.0):
        super().__init__(kind)
        self.kind, self.wait = kind, wait


# Words of a refusal for a used-up quota, and how it names the seconds to wait.
_QUOTA = re.compile(r"quota|per day|daily limit|billing", re.IGNORECASE)
_WAIT = re.compile(r"(?:retry|again|wait)\D{0,20}?(\d+(?:\.\d+)?)\s*(ms|s|sec|seconds?|m|min|minutes?)?\b", re.IGNORECASE)


def wait_of(text: str) -> float:
    """The seconds after which a refusal asks to be tried again; 0 where it doesn't say."""
    m = _WAIT.search(text or "")
    if not m:
        return 0.0
    unit = (m[2] or "s").lower()
    return float(m[1]) * (0.001 if unit == "ms" else 60.0 if unit.startswith("m") else 1.0)


def refusal_of(status: int, text: str = "") -> Unavailable | None:
    """What an HTTP status and its text mean: a rate limit, a used-up quota, a server's fault; None: an error of the request itself."""
    if status in (429, 403) and _QUOTA.search(text):
        return Unavailable("quota")
    if status == 429:
        return Unavailable("rate", wait_of(text))
    return Unavailable("server", wait_of(text)) if status >= 500 else None


def embedded_in_batches(text: Column, provider: Callable[[list[str]], list[list[float]]], size: int = 64) -> Column:
    """The vector (array<float>) of each text from a provider that takes ``size`` texts at a call; null texts have none and are not sent."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = texts.dropna()
            vectors = [v for i in range(0, len(known), size) for v in provider(known.iloc[i : i + size].tolist())]
            yield pd.Series(dict(zip(known.index, vectors, strict=True)), dtype=object).reindex(texts.index).where(lambda v: v.notna(), None)

    return embed(text)


def chained(providers: list[Callable[[object], object]], tries: int = 3, pause: Callable[[float], None] = time.sleep) -> Callable[[object], object]:
    """The first provider that answers: waits and tries again on rate limits and server faults, goes on at once on a used-up quota."""

    def call(request: object) -> object:
        last: Exception = Unavailable("server")
        for provider in providers:
            for i in range(tries):
                try:
                    return provider(request)
                except Unavailable as e:
                    last = e
                    if e.kind == "quota":
                        break
                    pause(e.wait or 2.0**i)
        raise last

    return call


class RateLimit:
    """At most ``n`` calls in any ``seconds`` of one Python worker; a cluster's total is that times its workers (coalesce to bound it)."""

    def __init__(self, n: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep):
        self.n, self.seconds, self.clock, self.pause = n, seconds, clock, pause
        self.calls: deque[float] = deque()

    def wait(self) -> None:
        while True:
            now = self.clock()
            while self.calls and now - self.calls[0] >= self.seconds:
                self.calls.popleft()
            if len(self.calls) < self.n:
                self.calls.append(now)
                return
            self.pause(self.seconds - (now - self.calls[0]))


def json_of(text: str | None) -> object:
    """The JSON value in a model's output: all of it, a fenced block, or the first object or list in it; raises ValueError."""
    t = (text or "").strip()
    if m := re.fullmatch(r"```(?:json)?\s*(.*?)\s*```", t, re.S):
        t = m[1]
    decoder = json.JSONDecoder()
    for at in [0, *(m.start() for m in re.finditer(r"[{\[]", t))]:
        try:
            value, end = decoder.raw_decode(t, at)
        except ValueError:
            continue
        if at or not t[end:].strip():
            return value
    raise ValueError("no JSON value in the text")

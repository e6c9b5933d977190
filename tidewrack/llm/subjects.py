"""Subject areas of documents, by what their statements are about.

A complement naive Bayes model over statements is trained from hand-labelled documents, refined with expectation
maximisation over the statements of all documents, and each area's share of a document's statements is calibrated into
a posterior of its own, so a document may have several areas or none.

Spark holds the statements and sums the expected counts; a driver sees the model only, whose size is fixed by
``Settings.buckets`` and the number of areas, and the shares of the labelled sample, bounded by ``Settings.labelled``.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import materialize

NONE = "none"
#: Features that a task handles at once; what bounds its memory beside the longest document.
BLOCK = 200_000
#: Slices of the buckets in which counts are summed.
SLICES = 512
#: Letters of a long word, and of its beginning.
LONG, BEGINNING = 6, 5


@dataclass(frozen=True)
class Settings:
    """``labelled``: at most so many labelled documents are used, those with the least hash. ``buckets``: hashed features."""

    labelled: int = 50_000
    buckets: int = 1 << 17
    rounds: int = 3
    alpha: float = 0.05
    label_mass: float = 0.9  # of a statement's prior, on the labels of its document and none
    own_mass: float = 0.7  # of a statement's prior, on the areas of its document's other statements
    none_bias: float = 2.0  # evidence, in nats, that a statement needs to be about an area
    statement_words: int = 12  # text without marks is read in runs of so many words
    longest: int = 24


_MARKS = re.compile(r"^[\s>*#=•\-–]+|^\s*\d+[.)]\s+")
_ENDS = re.compile(r"(?<=[.!?])[\s\"')\]]+|[\r\n  ]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")


def statements(text: str | None, settings: Settings = Settings()) -> list[list[str]]:
    """The words, in lower case, of each statement of a text; lines and sentences, and runs of words where marks are missing."""
    out = []
    for piece in _ENDS.split(text or ""):
        words = _WORD.findall(_MARKS.sub("", piece).lower())
        if len(words) > settings.longest:
            n = max(1, round(len(words) / settings.statement_words))
            size = -(-len(words) // n)
            out += [words[i : i + size] for i in range(0, len(words), size)]
        elif words:
            out.append(words)
    return out


class Features:
    """Hashed words, pairs of neighbours, and beginnings of long words without accents, which languages share and typing errors mostly spare.

    A word is hashed once; the features of all statements of a batch follow from its words' hashes as arrays.
    """

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of_word(self, word: str) -> tuple[int, int]:
        """Hash of a word, and the bucket of its beginning (-1: not long)."""
        beginning = -1
        if len(word) >= LONG:
            plain = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
            beginning = zlib.crc32(b"^" + plain[:BEGINNING].encode()) % self.buckets
        return zlib.crc32(word.encode()), beginning

    def __call__(self, said: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(number of features of each statement, all features in their order)."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        found = []
        for words in said:
            for w in words:
                f = known.get(w)
                if f is None:
                    f = known[w] = self.of_word(w)
                found.append(f)
        hashes, beginnings = np.array(found, "int64").reshape(-1, 2).T
        lengths = np.array([len(words) for words in said], "int64")
        of = np.repeat(np.arange(len(said)), lengths)
        pairs = np.flatnonzero(of[1:] == of[:-1])
        mixed = (hashes[pairs] * 0x9E3779B1 + hashes[pairs + 1] * 0x85EBCA77) & 0x7FFFFFFFFFFFFFFF
        long = np.flatnonzero(beginnings >= 0)
        owner = np.concatenate([of, of[pairs], of[long]])
        features = np.concatenate([hashes % self.buckets, (mixed ^ mixed >> 29) % self.buckets, beginnings[long]])
        return np.bincount(owner, minlength=len(said)), features[np.argsort(owner, kind="stable")].astype("int32")


def featurize(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, sizes (features of each statement), features: of each document with a statement; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Features(settings.buckets)
        for b in batches:
            said = [statements(t, settings) for t in b.column("text").to_pylist()]
            per_doc = np.array([len(s) for s in said], "int64")
            sizes, features = hashed([s for ss in said for s in ss])
            kept = np.flatnonzero(per_doc)
            ends = np.cumsum(per_doc)[kept]
            at = np.concatenate([[0], np.cumsum(sizes)])
            lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(kept)), lists(sizes, ends), lists(features, at[ends])], names=["doc_id", "sizes", "features"])

    x = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return x.mapInArrow(run, "doc_id bigint, sizes array<int>, features array<int>")


def label_weights(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """doc_id, weights (array<double>, of each subject, the part of the document's annotators who gave it)."""
    x = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(*subjects)).select("doc_id", "subject", F.coalesce("annotator", F.lit("")).alias("annotator")).distinct()
    by = x.groupBy("doc_id").agg(F.countDistinct("annotator").alias("n"), *[F.count_if(F.col("subject") == s).alias(f"s{i}") for i, s in enumerate(subjects)])
    return by.select("doc_id", F.array(*[(F.col(f"s{i}") / F.col("n")) for i in range(len(subjects))]).alias("weights"))


def complement_weights(counts: np.ndarray, alpha: float) -> np.ndarray:
    """(buckets, subjects) log weights from expected counts: how unlikely a feature is in all subjects but this one."""
    rest = counts.sum(1, keepdims=True) - counts + alpha
    return -(np.log(rest) - np.log(rest.sum(0, keepdims=True))).astype("float32")


def without_own(counts: np.ndarray, alpha: float, b: Block, p: np.ndarray) -> np.ndarray:
    """Log weights (features, subjects) of each feature of a block from the expected counts without those of its own document.

    ``p`` are the posteriors of the block's statements that are part of the counts.
    """
    doc = np.repeat(b.doc_of, b.sizes)
    each, at = np.unique(doc * np.int64(len(counts)) + b.features, return_inverse=True)
    mass = np.repeat(p, b.sizes, axis=0)
    own = np.stack([np.bincount(at, weights=mass[:, c], minlength=len(each)) for c in range(p.shape[1])], 1)
    per_doc = np.stack([np.bincount(doc, weights=mass[:, c], minlength=len(b)) for c in range(p.shape[1])], 1)
    other = lambda x: np.maximum(x.sum(-1, keepdims=True) - x, 0.0)
    total = other(counts.sum(0)) + alpha * len(counts)
    rest = np.maximum(other(counts[b.features]) - other(own)[at], 0.0) + alpha
    return -(np.log(rest) - np.log(np.maximum(total - other(per_doc), alpha))[doc])


def _posteriors(model: np.ndarray, sizes: np.ndarray, features: np.ndarray, doc_of: np.ndarray, prior: np.ndarray, n_docs: int, s: Settings) -> np.ndarray:
    """Posterior of each subject (the last is none) of each statement; ``prior`` is that of each document."""
    return _statement_posteriors(model[features], sizes, doc_of, prior, n_docs, s)


def _statement_posteriors(weights: np.ndarray, sizes: np.ndarray, doc_of: np.ndarray, prior: np.ndarray, n_docs: int, s: Settings) -> np.ndarray:
    """As ``_posteriors``, from the weights of each feature."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = np.add.reduceat(weights, starts, axis=0).astype("float64")
    scores[:, -1] += s.none_bias
    scores -= scores.max(1, keepdims=True)
    like = np.exp(scores)
    per_doc = np.bincount(doc_of, minlength=n_docs)[:, None]
    p = like * prior[doc_of]
    p /= p.sum(1, keepdims=True)
    for _ in range(2):  # the document's other statements make its areas likelier
        mix = np.stack([np.bincount(doc_of, weights=p[:, c], minlength=n_docs) for c in range(p.shape[1])], 1) / np.maximum(per_doc, 1)
        p = like * (((1 - s.own_mass) * prior + s.own_mass * mix)[doc_of])
        p /= p.sum(1, keepdims=True)
    return p


@dataclass
class Block:
    """Documents of a task whose statements together have about ``BLOCK`` features, as flat arrays."""

    doc_ids: np.ndarray
    sizes: np.ndarray  # features of each statement
    features: np.ndarray
    doc_of: np.ndarray  # document of each statement
    weights: list | None

    def __len__(self) -> int:
        return len(self.doc_ids)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the rows (doc_id, sizes, features and perhaps weights); a document is never cut."""
    for b in batches:
        sizes, features = b.column("sizes"), b.column("features")
        weights = b.column("weights").to_pylist() if "weights" in b.schema.names else None
        per_doc, per_features = sizes.value_lengths().to_numpy(), features.value_lengths().to_numpy()
        at = 0
        while at < len(b):
            n = max(1, int(np.searchsorted(np.cumsum(per_features[at:]), BLOCK, side="right")))
            cut = slice(at, at + n)
            yield Block(
                b.column("doc_id").slice(at, n).to_numpy(zero_copy_only=False), sizes.slice(at, n).flatten().to_numpy(), features.slice(at, n).flatten().to_numpy(),
                np.repeat(np.arange(n), per_doc[cut]), weights[cut] if weights else None,
            )
            at += n


def _priors(b: Block, k: int, s: Settings) -> np.ndarray:
    flat = np.full(k, 1.0 / k)
    out = np.tile(flat, (len(b), 1))
    for i, w in enumerate(b.weights or ()):
        if w is not None and sum(w) > 0:
            w = np.array(w, "float64")
            w[-1] = max(w[-1], 0.25)
            out[i] = s.label_mass * w / w.sum() + (1 - s.label_mass) * flat
    return out


def _sum_counts(rows: DataFrame, buckets: int, k: int, expect: Callable[[Block], np.ndarray]) -> np.ndarray:
    """Expected counts (buckets, k) from the posteriors that ``expect`` gives of a block's statements.

    There are no more tasks than cores, so what is shuffled doesn't grow with the documents: each sends its own sums in
    slices of the buckets, and a slice is summed in one task. The driver gets one row a slice.
    """
    width = -(-buckets // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width * SLICES))
        for b in _blocks(batches):
            p = np.repeat(expect(b).T, b.sizes, axis=1)
            for c in range(k):
                total[c] += np.bincount(b.features, weights=p[c], minlength=total.shape[1])
        parts = total.astype("float32").reshape(k, SLICES, width).transpose(1, 0, 2)
        at = np.flatnonzero(parts.any((1, 2)))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array([parts[i].tobytes() for i in at], pa.binary())], names=["slice", "part"])

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, "float32").astype("float64") for p in parts["part"]], axis=0)
        return pd.DataFrame({"slice": parts["slice"].iloc[:1], "part": [total.tobytes()]})

    few = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    found = few.mapInArrow(run, "slice int, part binary").groupBy("slice").applyInPandas(add, "slice int, part binary").toPandas()  # at most ``SLICES`` rows
    out = np.zeros((SLICES, k, width))
    for i, part in zip(found["slice"], found["part"], strict=True):
        out[i] = np.frombuffer(part, "float64").reshape(k, width)
    return out.transpose(1, 0, 2).reshape(k, -1)[:, :buckets].T


@dataclass
class SubjectModel:
    subjects: list[str]  # the last is none
    weights: np.ndarray
    slope: float
    offsets: np.ndarray  # of each subject but none
    settings: Settings

    def shares(self, b: Block) -> np.ndarray:
        """The part of each document's statements that is about each subject; labels of the document are not used."""
        return self.shares_of(self.weights[b.features], b)

    def shares_of(self, weights: np.ndarray, b: Block) -> np.ndarray:
        """The same from the weights of each feature."""
        k = len(self.subjects)
        p = _statement_posteriors(weights, b.sizes, b.doc_of, np.full((len(b), k), 1.0 / k), len(b), self.settings)
        sure = np.where(p >= 0.5, p, 0)
        n = np.maximum(np.bincount(b.doc_of, minlength=len(b)), 1)
        return np.stack([np.bincount(b.doc_of, weights=sure[:, c], minlength=len(b)) / n for c in range(k)], 1)

    def posteriors(self, shares: np.ndarray) -> np.ndarray:
        """Calibrated, independent posteriors of the subjects but none."""
        return 1 / (1 + np.exp(-(self.slope * _stretch(shares[:, :-1]) + self.offsets)))


def _stretch(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.02) / (1.02 - share))


def calibrate(shares: np.ndarray, given: np.ndarray, ridge: float = 4.0) -> tuple[float, np.ndarray]:
    """(slope, offset of each subject) of the logistic that turns shares into posteriors; offsets lean to a common one."""
    x, k = _stretch(shares), given.shape[1]
    a, b, d = 1.0, 1.5, np.zeros(k)
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * x + b + d)))
        e, h = p - given, p * (1 - p) + 1e-6
        a = max(0.1, a - ((e * x).sum() + (a - 2.0)) / ((h * x * x).sum() + 1.0))
        b -= e.sum() / (h.sum() + 1.0)
        d -= (e.sum(0) + ridge * d) / (h.sum(0) + ridge)
    return float(a), b + d


def train(documents: DataFrame, areas: DataFrame, labels: DataFrame, settings: Settings = Settings(), features: DataFrame | None = None) -> SubjectModel:
    """The model of the areas (a fixed list) from the labels and the statements of all documents.

    Each labelled document is weighed for the calibration by the counts without its own, as an unlabelled one is.

    Without labels, or with labels only of unknown documents, the model knows nothing and no document gets an area.
    """
    s = settings
    subjects = sorted(r["subject"] for r in areas.select("subject").where("subject IS NOT NULL").distinct().collect()) + [NONE]
    k, buckets = len(subjects), s.buckets
    rows = features if features is not None else materialize(featurize(documents, s))
    given = label_weights(labels, subjects)
    given = materialize(given.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.labelled))
    known = materialize(rows.join(given, "doc_id"))

    def from_labels(b: Block) -> np.ndarray:
        w = np.array(b.weights)
        return (w / np.maximum(w.sum(1, keepdims=True), 1e-9))[b.doc_of]

    counts = _sum_counts(known, buckets, k, from_labels)
    model = complement_weights(counts, s.alpha)
    every = rows.join(given, "doc_id", "left")
    context, before = rows.sparkSession.sparkContext, model
    for _ in range(s.rounds):
        shared, before = context.broadcast(model), model

        def refined(b: Block, shared=shared) -> np.ndarray:
            return _posteriors(shared.value, b.sizes, b.features, b.doc_of, _priors(b, k, s), len(b), s)

        counts = _sum_counts(every, buckets, k, refined)
        model = complement_weights(counts, s.alpha)
        shared.destroy()
    out = SubjectModel(subjects, model, 2.0, np.full(k - 1, 2.0), s)
    shared = context.broadcast((out, before, counts))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, before, counts = shared.value
        for b in _blocks(batches):
            p = _posteriors(before, b.sizes, b.features, b.doc_of, _priors(b, k, s), len(b), s) if s.rounds else from_labels(b)
            found = m.shares_of(without_own(counts, s.alpha, b, p), b)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.list_(pa.float64())), pa.array(b.weights, pa.list_(pa.float64()))], names=["s", "w"])

    seen = known.mapInArrow(shares, "s array<double>, w array<double>").toPandas()  # at most ``labelled`` rows
    if len(seen):
        sh, w = np.stack(seen["s"].to_numpy()), np.stack(seen["w"].to_numpy())
        out.slope, out.offsets = calibrate(sh[:, :-1], w[:, :-1])
    shared.destroy()
    return out


def subject_posteriors(model: SubjectModel, features: DataFrame) -> DataFrame:
    """doc_id, subject, share, posterior: of each document with statements, every area."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = m.subjects[:-1]
        for b in _blocks(batches):
            sh = m.shares(b)
            columns = [np.repeat(b.doc_ids, len(names)), names * len(b), sh[:, :-1].ravel(), m.posteriors(sh).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "subject", "share", "posterior"])

    return features.mapInArrow(run, "doc_id bigint, subject string, share double, posterior double")


def subject_areas(documents: DataFrame, areas: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, subject, share, posterior: one row for each area with a posterior of a half or more.

    Null, empty and blank texts and texts without words have no row. Documents that repeat an id get one row for
    each area found in any of them. Extra columns are ignored.
    """
    rows = materialize(featurize(documents, settings))
    model = train(documents, areas, labels, settings, rows)
    found = subject_posteriors(model, rows).where(F.col("posterior") >= 0.5)
    return found.groupBy("doc_id", "subject").agg(F.max("share").alias("share"), F.max("posterior").alias("posterior"))

"""Lexical and vector retrieval over all documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewrack.functions.text import tokens
from tidewrack.operators.folds import top_per_key
from tidewrack.session import materialize, materialize_all

#: Constants of BM25.
K1, B = 1.2, 0.75


def token_counts(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, token, tf, length) of each document; documents without tokens have no row."""
    x = documents.select(id_column, tokens(F.col(text)).alias("t")).withColumn("length", F.size("t"))
    return x.select(id_column, "length", F.explode("t").alias("token")).groupBy(id_column, "length", "token").agg(F.count("*").alias("tf"))


def document_frequency(documents: DataFrame, id_column: str, text: str) -> DataFrame:
    """(token, df): in how many documents a token occurs; each document's own repetitions are removed in its row."""
    x = documents.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("df"))


def _counts(text: str, terms: list[str]) -> Column:
    """(length, tf) of a text: its tokens, and how many of them are each term; the text is split once."""

    def occurrences(words: Column, term: str) -> Column:
        return F.size(F.filter(words, lambda w: w == F.lit(term)))

    def counted(words: Column) -> Column:
        return F.struct(F.size(words).alias("length"), F.array(*[occurrences(words, t) for t in terms]).cast("array<int>").alias("tf"))

    return F.get(F.transform(F.array(tokens(F.col(text))), counted), F.lit(0))


def bm25(documents: DataFrame, id_column: str, text: str, query: str) -> DataFrame:
    """(id, score) of the documents with a token of the query; a token that the query repeats counts as often.

    One pass over the texts leaves the counts of the few query tokens in every document, from which lengths,
    frequencies and scores follow; the vocabulary is never shuffled.
    """
    spark = documents.sparkSession
    asked = spark.range(1).select(tokens(F.lit(query)).alias("t")).head()["t"]
    terms = sorted(set(asked))
    x = materialize(documents.select(id_column, _counts(text, terms).alias("c")).select(id_column, "c.*"))
    tf = [F.get("tf", F.lit(i)).cast("double") for i in range(len(terms))]
    stats = x.agg(F.count("*").alias("n"), F.sum("length").alias("total"), *[F.count_if(t > 0).alias(f"df{i}") for i, t in enumerate(tf)]).head()
    average = (stats["total"] or 0) / max(1, stats["n"])
    score = F.lit(0.0)
    for i, q in enumerate(terms):
        df = F.lit(float(stats[f"df{i}"]))
        idf = F.greatest(F.lit(0.0), F.ln((F.lit(float(stats["n"])) - df + 0.5) / (df + 0.5) + 1))
        score = score + F.lit(float(asked.count(q))) * idf * tf[i] * (K1 + 1) / (tf[i] + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
    return x.where(F.exists("tf", lambda n: n > 0)).select(id_column, score.alias("score"))


def keyword_score(documents: DataFrame, id_column: str, text: str, terms: list[str]) -> DataFrame:
    """(id, score): the part of the terms that the text contains in any case; documents with none have no row."""
    low = F.lower(F.col(text))
    hits = sum((F.when(F.contains(low, F.lit(t.lower())), 1).otherwise(0) for t in terms), F.lit(0))
    return documents.select(id_column, (hits / F.lit(float(len(terms)))).alias("score")).where("score > 0")


def _best_of(block: list[Row], k: int, size: int = 1024) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's k best rows of each query of a block (query_id, q): products with ``size`` rows at a time, only the best are kept."""

    def unit(vectors) -> np.ndarray:
        m = np.array([np.asarray(x, "float64") for x in vectors])
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)

    qi = np.array([x["query_id"] for x in block], "int64")
    q = unit([x["q"] for x in block]) if block else np.zeros((0, 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, best = np.zeros((len(qi), 0), "int64"), np.zeros((len(qi), 0))
        for b in batches:
            for at in range(0, len(b), size):
                vi = b["id"].to_numpy("int64")[at : at + size]
                score = np.round(q @ unit(b["v"].iloc[at : at + size]).T, 6) + 0.0
                score[qi[:, None] == vi[None, :]] = -np.inf
                ids, best = np.hstack([ids, np.broadcast_to(vi, score.shape)]), np.hstack([best, score])
                order = np.lexsort((ids, -best), axis=-1)[:, :k]
                ids, best = np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)
        found = np.isfinite(best)
        yield pd.DataFrame({"query_id": np.repeat(qi, found.sum(axis=1)), "id": ids[found], "score": best[found]})

    return run


def cosine_top(queries: DataFrame, rows: DataFrame, id_column: str, vector: str, k: int, block: int = 2048) -> DataFrame:
    """(query_id, id, score, place): the k rows of greatest cosine of each query vector, itself left out; exact.

    Queries go out in blocks of about ``block``, one block a job. The rows are read where they lie and never grouped or
    shuffled; each task passes on its k best of each query only. Vectors of norm 0 score 0. Null vectors are left out.
    Ties, at six digits, go to the lesser id.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("query_id"), F.col(vector).alias("q"))
    v = rows.where(F.col(vector).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector).alias("v"))
    n = max(1, -(-q.count() // block))

    def best(i: int) -> DataFrame:
        asked = q.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i).collect()
        found = (v if asked else v.limit(0)).mapInPandas(_best_of(asked, k), "query_id bigint, id bigint, score double")
        return top_per_key(found, ["query_id"], [F.desc("score"), F.asc("id")], k)

    return best(0) if n == 1 else materialize_all(best(i) for i in range(n))


def with_urgent(hits: DataFrame, topics: DataFrame, floor: int = 2, among: int = 5) -> DataFrame:
    """Semantic hits and, where they lack them, the topics of at least ``floor`` urgency among the most urgent ones."""
    urgent = topics.orderBy(F.desc("urgency"), F.desc("last_seen"), F.desc("mentions"), "topic").limit(among).where(F.col("urgency") >= floor)
    extra = urgent.join(hits, "topic", "left_anti").select("topic", F.lit("urgent").alias("why"))
    return hits.select("topic", F.lit("semantic").alias("why")).unionByName(extra)

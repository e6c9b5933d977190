"""The stored knowledge: new messages, topics, their history and evidence, and what a briefing shows of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewrack.operators.folds import CONFIDENCE_RANK, STATUS_RANK, rank_of, top_per_key


def first_deliveries(rows: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """One row for each id, the least by ``order``; rows without id are dropped. Aggregated before the shuffle."""
    rest = [c for c in rows.columns if c != id_column]
    ordered = [*order, *[c for c in rest if c not in order]]
    x = rows.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.min(F.struct(*ordered)).alias("_r"))
    return x.select(id_column, *[F.col(f"_r.{c}").alias(c) for c in rest])


def new_rows(arriving: DataFrame, stored: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """Arriving rows whose id is not stored, the first of each id: insert or ignore."""
    return first_deliveries(arriving, id_column, order).join(stored.select(id_column), id_column, "left_anti")


def ranked_topics(topics: DataFrame, status: str | None = None) -> DataFrame:
    """Topics with their place by urgency, last sight and mentions (then key)."""
    x = topics.where(F.col("status") == status) if status else topics
    return x.withColumn("urgency", rank_of(F.col("status"), STATUS_RANK))


def briefing(topics: DataFrame, n: int = 12) -> DataFrame:
    """The n topics that a briefing shows, by status, confidence and key; a top-n report."""
    x = topics.withColumn("_s", rank_of(F.col("status"), STATUS_RANK)).withColumn("_c", rank_of(F.col("confidence"), CONFIDENCE_RANK))
    return x.orderBy(F.desc("_s"), F.desc("_c"), "topic").limit(n).drop("_s", "_c")


def briefing_tail(topics: DataFrame, shown: DataFrame) -> DataFrame:
    """Counts by status of the topics that a briefing doesn't show."""
    return topics.join(shown.select("topic"), "topic", "left_anti").groupBy("status").agg(F.count("*").alias("n"))


def history(readings: DataFrame, key: str, n: int) -> DataFrame:
    """The last n readings of each key, latest first."""
    return top_per_key(readings, [key], [F.desc("seen_at"), F.desc("seq")], n)


def evidence_for(evidence: DataFrame, artifacts: DataFrame, n: int = 6) -> DataFrame:
    """The n latest pieces of evidence of each topic with the time of their artifact; unknown artifacts come last."""
    x = evidence.join(artifacts, "artifact_id", "left")
    return top_per_key(x, ["topic_key"], [F.desc_nulls_last("ts"), F.asc("artifact_id"), F.asc("evidence_id")], n)


def stale_embeddings(topics: DataFrame) -> DataFrame:
    """Topics (text, embedded_for) whose text is not the one that was embedded; null-safe."""
    return topics.where(~F.col("text").eqNullSafe(F.col("embedded_for")))


def looked_up(topics: DataFrame, key: str, asked: str, n: int) -> DataFrame:
    """The n first topics, by key, whose key is the one asked for in any case; else those whose key contains it."""
    low = F.lower(F.col(key))
    near = topics.where(F.contains(low, F.lit(asked.lower()))).withColumn("_far", (low != asked.lower()).cast("int"))
    best = near.orderBy("_far", key).limit(n)
    return best.withColumn("_least", F.min("_far").over(W.partitionBy(F.lit(0)))).where("_far = _least").drop("_far", "_least")
